"""Day pruning never loses rows: it is used only where the day column provably is the day."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transitlens import TimeWindow, clock_window, load_partitioned, preview, restrict, time_extent, write_partitioned
from transitlens.functions.predicates import day_is_known
from transitlens.schema import PING_COLUMNS, SERVICE_DATE
from transitlens.sources.events import load_event_pings

WINDOW = TimeWindow(datetime(2024, 1, 5), datetime(2024, 1, 7))


@pytest.fixture(scope="module")
def layout(spark):
    from transitlens.session import scratch_path

    return load_partitioned(
        spark, write_partitioned(load_event_pings(spark, "/root/testdata/sf0.01"), scratch_path(spark, "test-prune"))
    )


def shifted(df):
    return df.withColumn("datetime", F.col("datetime") - F.expr("INTERVAL 3 HOURS"))


CASES = {
    "shifted": shifted,
    "renamed": lambda df: df.select(*PING_COLUMNS, F.lit("2020-01-01").cast("date").alias(SERVICE_DATE)),
    "foreign": lambda df: df.drop(SERVICE_DATE).withColumn("service_date", F.lit("2020-01-01").cast("date")),
    "united": lambda df: df.union(shifted(df).select(*df.columns)),
}


@pytest.mark.parametrize("case", CASES)
def test_unprovable_days_are_not_pruned(spark, layout, case):
    df = CASES[case](layout)
    plain = df.select(*PING_COLUMNS)
    assert not day_is_known(df)
    ts = F.col("datetime")
    want = plain.where((ts > F.lit("2024-01-05").cast("timestamp_ntz")) & (ts < F.lit("2024-01-07").cast("timestamp_ntz")))
    assert restrict(df, window=WINDOW).count() == want.count() > 0
    assert time_extent(df).first() == plain.agg(F.min(ts), F.max(ts)).first()
    window = clock_window(df, "08:00:00", "17:00:00")
    low, high = plain.agg(F.min(ts), F.max(ts)).first()
    assert (window.start.date(), window.end.date()) == (low.date(), high.date())
    rows = lambda x: [r.datetime for r in x.select(*PING_COLUMNS).collect()]
    order = ["datetime", "bus_line", "speed", "bus_id"]
    assert rows(preview(df, 20, order)) == rows(plain.orderBy(*order).limit(20))


def test_the_plain_layout_is_pruned(layout):
    assert day_is_known(layout) and day_is_known(layout.where("speed > 1"))
    plan = restrict(layout, window=WINDOW)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ping_layout_day" in plan
