"""The clock report from partial aggregates equals the one from restricted rows, in two passes."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from helpers import ROOT, write_lines
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from transitlens import clock_report, clock_window, load_pings, report
from transitlens.plans.report import WINDOW_SPEC
from transitlens.session import scratch_path

SCHEMA = "bus_id string, bus_line string, latitude double, longitude double, speed double, datetime timestamp_ntz"
clocks = st.sampled_from(["00:00:00", "00:00:01", "08:00:00", "12:30:15", "23:59:59"])
times = st.one_of(
    st.none(),
    st.builds(
        lambda d, clock, micros: datetime(2014, 10, 1 + d) + timedelta(hours=clock.hour, minutes=clock.minute, seconds=clock.second, microseconds=micros),
        st.integers(0, 3),
        clocks.map(lambda x: datetime.strptime(x, "%H:%M:%S")),
        st.sampled_from([0, 1, 999_999]),
    ),
)
pings = st.tuples(
    st.just("b"), st.sampled_from(["1", "2", "", None]), st.just(0.0), st.just(0.0),
    st.sampled_from([0.0, 5.5, 100.0, 100.5, 120.0, -3.0, 1e6, None]), times,
)


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r[:4])
    a, b = sorted((tuple(r) for r in a.collect()), key=key), sorted((tuple(r) for r in b.collect()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:4] == y[:4]
        for u, v in zip(x[4:], y[4:]):
            assert u == v if u is None or v is None else u == pytest.approx(v, rel=1e-9, abs=1e-9)


@settings(max_examples=10, phases=[Phase.generate], deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(pings, max_size=25), start=clocks, end=clocks)
def test_equals_the_restricted_rows(spark, rows, start, end):
    df = spark.createDataFrame(rows, SCHEMA)
    got = clock_report(df, start, end)
    want = report(df, window=clock_window(df, start, end), spec=WINDOW_SPEC)
    assert list(got) == list(want)
    same(got.long(), want.long())
    for name in got:
        assert got[name].columns == want[name].columns
        assert got[name].count() == want[name].count()


def day(d, clocks, speed):
    return [f"10-{d:02d}-2014,{c},b,L{d},-22.9,-43.3,{speed}" for c in clocks]


@pytest.mark.parametrize("strict", [False, True])
def test_file_order_comes_from_the_same_pass(spark, scratch, strict):
    """Listed against the calendar: from the 3rd to the 2nd, nothing lies between."""
    files = {d: write_lines(spark, f"{scratch('order')}/{d}", day(d, ["07:00:00", "09:00:00", "18:00:00"], 10 * d)) for d in (1, 2, 3)}
    for listed in ([1, 2, 3], [3, 1, 2], [2]):
        df = load_pings(spark, [files[d] for d in listed], strict=strict)
        got = clock_report(df, "08:00:00", "17:00:00", extent="file_order")
        want = report(df, window=clock_window(df, "08:00:00", "17:00:00", extent="file_order"), spec=WINDOW_SPEC)
        same(got.long(), want.long())
    with pytest.raises(ValueError):
        clock_report(df.union(df), "08:00:00", "17:00:00", extent="file_order")
    with pytest.raises(ValueError):
        clock_report(df, "08:00:00", "17:00:00", extent="nope")


def test_squares_far_from_zero(spark):
    rows = [("b", "1", 0.0, 0.0, -1e9 + i % 2, datetime(2014, 10, 1 + i % 3, 12)) for i in range(30)]
    got = clock_report(spark.createDataFrame(rows, SCHEMA), "00:00:00", "23:59:59")["stats"].first()
    assert got.variance_speed == pytest.approx(30 * 0.25 / 29, rel=1e-6)


SCRIPT = """
import sys
from transitlens import clock_report, load_pings
from transitlens.session import local_session
logs, text, order = sys.argv[1:]
spark = local_session(2, extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logs, "spark.eventLog.compress": "false"})
pings = load_pings(spark, text)
clock_report(pings, "08:00:00", "17:00:00", extent=order).long().write.format("noop").mode("overwrite").save()
spark.stop()
"""


@pytest.mark.parametrize("order", ["range", "file_order"])
def test_the_long_form_reads_text_twice(spark, scratch, tmp_path, order):
    # speed 0: the pushed bounds of the observation sections drop no row before it is counted
    lines = [line for d in (1, 2, 3, 4) for line in day(d, [f"{h:02d}:00:00" for h in range(24)], 0)]
    text = write_lines(spark, scratch_path(spark, "scan-count"), lines)
    env = os.environ | {"PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path), text, order], check=True, env=env, cwd=tmp_path, capture_output=True, timeout=300)
    read = 0
    for folder, _, names in os.walk(tmp_path):
        for name in names:
            if name.startswith(("events", "app", "local")):
                with open(os.path.join(folder, name)) as f:
                    events = [json.loads(x) for x in f]
                scans = {
                    s["Stage Info"]["Stage ID"]
                    for s in events
                    if s["Event"] == "SparkListenerStageSubmitted" and any("csv" in r.get("Scope", "") for r in s["Stage Info"]["RDD Info"])
                }
                read += sum(
                    e["Task Metrics"]["Input Metrics"]["Records Read"]
                    for e in events
                    if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in scans
                )
    assert read == 2 * len(lines)
