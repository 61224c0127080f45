"""Every registered query against its DuckDB oracle (the driver's correctness gate)."""

from __future__ import annotations

import pytest
from oracle import compare, duck

import __spark_entry__ as E

KEYS = sorted(E.ping_queries())


def test_every_query_has_an_oracle():
    assert set(E.ping_oracle_sql()) == set(E.ping_queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module", params=["0.001", "0.01"])
def sf_dir(request):
    return f"/root/testdata/sf{request.param}"


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, sf_dir, con, key):
    ok, msg = compare(E.queries()[key](spark, sf_dir), con, E.oracle_sql()[key])
    assert ok, f"{key}: {msg}"


def test_entry_smoke(spark):
    from transitlens.plans.report import LONG_SCHEMA

    df = E.entry(spark)
    assert df.count() == 21
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in LONG_SCHEMA
    ]


@pytest.mark.parametrize(
    "key", ["ts_compose", "window_filter", "time_extent", "clock_window_stats", "report_day_clock"]
)
def test_time_keys_independent_of_session_zone(spark, key):
    sf_dir = "/root/testdata/sf0.01"
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        ok, msg = compare(E.queries()[key](spark, sf_dir), duck(sf_dir), E.oracle_sql()[key])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, f"{key}: {msg}"


@pytest.mark.parametrize("key", ["scan_parse", "ts_compose", "scan_day_union", "report_all"])
def test_an_unwritable_scratch_folder_fails_the_query(spark, monkeypatch, key):
    monkeypatch.setattr(E, "_MEMO", {})
    monkeypatch.setattr(E, "scratch_path", lambda s, name: f"/proc/unwritable/{name}")
    with pytest.raises(Exception, match="unwritable"):
        E.queries()[key](spark, "/root/testdata/sf0.01")


@pytest.mark.parametrize("key", ["scan_parse", "ts_compose", "scan_day_union"])
def test_source_keys_scan_text_with_the_speed_bound_pushed(spark, key):
    plan = E.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and "LessThanOrEqual(speed,120.0)" in plan
