from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for p in (ROOT, os.path.join(ROOT, "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)

from transitlens.session import local_session, scratch_path  # noqa: E402

TESTDATA = "/root/testdata"

# the sample of real pings is not part of the repository
collect_ignore = [] if os.environ.get("TRANSITLENS_SAMPLE") else ["test_golden_sample.py"]


@pytest.fixture(scope="session")
def spark():
    # The cluster's spark.checkpoint.dir wins; a private folder only when it is unset.
    # TRANSITLENS_TEST_TZ runs the whole suite in another session zone (results must not
    # change: every time is wall-clock TIMESTAMP_NTZ).
    zone = os.environ.get("TRANSITLENS_TEST_TZ")
    extra = {"spark.sql.session.timeZone": zone} if zone else None
    session = local_session("*", shuffle_partitions=8, extra_conf=extra)
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    """A fresh folder below the shared scratch folder."""

    def make(name: str = "t") -> str:
        return scratch_path(spark, f"test-{name}")

    return make
