"""Day folders of text as partitions: a window opens only the folders it can touch."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transitlens import TimeWindow, load_day_folders, load_pings, restrict, write_day_files

SCHEMA = "bus_id string, bus_line string, latitude double, longitude double, speed double, datetime timestamp_ntz"


@pytest.fixture(scope="module")
def base(spark):
    from transitlens.session import scratch_path

    rows = [(f"b{d}{h}", "7", -22.9, -43.3, float(h), datetime(2021, 3, d, h)) for d in range(1, 8) for h in (0, 6, 18)]
    rows += [("undated", "7", 0.0, 0.0, 5.0, None), ("fast", "7", 0.0, 0.0, 121.0, datetime(2021, 3, 2))]
    return write_day_files(spark.createDataFrame(rows, SCHEMA).coalesce(1), scratch_path(spark, "day-folders"))


def ids(df):
    return sorted(r.bus_id for r in df.collect())


WINDOWS = {
    "inside": TimeWindow(datetime(2021, 3, 2), datetime(2021, 3, 4, 6)),
    "to midnight": TimeWindow(datetime(2021, 3, 2, 1), datetime(2021, 3, 4)),
    "none": TimeWindow.empty(),
    "beyond": TimeWindow(datetime(2030, 1, 1), datetime(2031, 1, 1)),
    "all": TimeWindow(datetime(2000, 1, 1), datetime(2031, 1, 1)),
}


@pytest.mark.parametrize("name", WINDOWS)
def test_equals_a_restriction_of_all_files(spark, base, name):
    got = load_day_folders(spark, base, WINDOWS[name])
    want = restrict(load_pings(spark, base), window=WINDOWS[name])
    assert got.schema == want.schema
    assert ids(got) == ids(want)


def test_without_a_window_every_row_comes_back(spark, base):
    got = load_day_folders(spark, base)
    assert ids(got) == ids(load_pings(spark, base)) and "undated" in ids(got) and "fast" not in ids(got)


def test_a_window_prunes_folders(spark, base):
    window = WINDOWS["inside"]
    df = load_day_folders(spark, base, window)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "LessThanOrEqual(speed,120.0)" in plan
    read = {f.rsplit("/", 2)[1] for f in df.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read == {"day=2021-03-02", "day=2021-03-03", "day=2021-03-04"} and len(ids(df)) == 6


def test_one_day(spark, base):
    day = TimeWindow(datetime(2021, 3, 5), datetime(2021, 3, 5, 23))
    assert ids(load_day_folders(spark, base, day)) == ["b518", "b56"]
