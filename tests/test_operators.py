"""Filters, aggregates, observation lists and windows on hand-made rows (F1-F7, A1-A6,
O1-O3, T1-T5), with every strict bound checked at the bound itself."""

from __future__ import annotations

import math
from datetime import datetime, time

import pytest
from helpers import write_lines
from pyspark.sql import functions as F
from test_source import ROWS

from transitlens import (
    Box,
    TimeWindow,
    at_speed,
    clock_window,
    day_clock_window,
    day_window,
    drop_outliers,
    faster_than,
    line_mean,
    load_pings,
    restrict,
    slower_than,
    speed_stats,
    time_extent,
)
from transitlens.session import scratch_path

BOX = Box(east=-43.2, west=-43.3, north=-22.8, south=-22.9)
DAY1 = day_window(1, 2)


@pytest.fixture(scope="module")
def pings(spark):
    return load_pings(spark, write_lines(spark, scratch_path(spark, "ops-rows"), ROWS)).cache()


def ids(df):
    return sorted(r.bus_id for r in df.collect())


def test_box_from_reference_argument_order():
    assert Box.from_args(-43.24, -43.26, -22.875, -22.9) == Box(-43.24, -43.26, -22.875, -22.9)


def test_box_rejects_missing_bound():
    with pytest.raises(ValueError):
        Box(east=None, west=-1.0, north=1.0, south=0.0)


def test_window_needs_both_bounds():
    with pytest.raises(ValueError):
        TimeWindow(datetime(2014, 10, 1), None)


def test_restrict_needs_a_shape(pings):
    with pytest.raises(ValueError):
        restrict(pings)


def test_box_filter_edges_and_nulls(pings):
    # T9 sits on the north-east corner (outside); T11 has no latitude (outside).
    assert ids(restrict(pings, box=BOX)) == sorted(
        ["T1", "T1", "T1", "T2", "T3", "T4", "T8", "T10", "T12", "T13", "T14"]
    )


def test_window_filter_edges_and_nulls(pings):
    # T10 sits on the window start (outside), T12 has no time, the day-2 row is outside.
    assert ids(restrict(pings, window=DAY1)) == sorted(
        ["T1", "T1", "T2", "T3", "T4", "T8", "T9", "T11", "T13", "T14"]
    )


def test_box_and_window_is_box_then_window(pings):
    both = ids(restrict(pings, box=BOX, window=DAY1))
    assert both == ids(restrict(restrict(pings, box=BOX), window=DAY1))
    assert both == sorted(["T1", "T1", "T2", "T3", "T4", "T8", "T13", "T14"])


def test_swapped_box_is_empty(pings):
    assert restrict(pings, box=Box(east=-43.3, west=-43.2, north=-22.8, south=-22.9)).count() == 0


def test_outlier_bound(spark):
    df = spark.createDataFrame([(120.0,), (120.01,), (float("nan"),), (None,), (-5.0,)], "speed double")
    assert sorted(r.speed for r in drop_outliers(df).collect()) == [-5.0, 120.0]


def test_speed_stats_box(pings):
    speeds = [35.5, 35.5, 45.0, 0.0, 12.0, 120.0, -1.0, 20.0, 20.0, 20.0, 20.0]
    row = speed_stats(pings, box=BOX).first()
    n = len(speeds)
    mean = sum(speeds) / n
    var = sum((x - mean) ** 2 for x in speeds) / (n - 1)
    assert row.mean_speed == pytest.approx(mean, rel=1e-12)
    assert row.variance_speed == pytest.approx(var, rel=1e-12)
    assert row.stddev_speed == pytest.approx(math.sqrt(var), rel=1e-12)
    assert (row.min_speed, row.max_speed) == (-1.0, 120.0)


def test_speed_stats_one_row_and_no_rows(pings):
    one = Box(east=-43.19, west=-43.21, north=-22.79, south=-22.81)  # only T9
    row = speed_stats(pings, box=one).first()
    assert row.mean_speed == 20.0 and row.variance_speed is None and row.stddev_speed is None
    empty = speed_stats(pings, box=Box(0.0, -1.0, 0.0, -1.0)).collect()
    assert len(empty) == 1 and all(v is None for v in empty[0])


def test_line_mean(pings):
    got = {r.bus_line: r.mean_speed for r in line_mean(pings, window=DAY1).collect()}
    assert got == pytest.approx(
        {"10.0": (35.5 + 35.5 + 120.0 - 1.0 + 20.0 + 20.0 + 20.0) / 7, "0": 0.0, "XY1": 12.0, "": 20.0}
    )
    assert line_mean(pings, window=DAY1).columns == ["bus_line", "mean_speed"]


def test_observations_bounds(pings):
    assert slower_than(pings, 20.0, box=BOX).columns == ["bus_line", "datetime", "speed"]
    slow = sorted(r.speed for r in slower_than(pings, 20.0, box=BOX).collect())
    fast = sorted(r.speed for r in faster_than(pings, 20.0, box=BOX).collect())
    exact = sorted(r.speed for r in at_speed(pings, 20.0, box=BOX).collect())
    assert slow == [-1.0, 0.0, 12.0]
    assert exact == [20.0] * 4
    assert fast == [35.5, 35.5, 45.0, 120.0]
    assert len(slow) + len(fast) + len(exact) == restrict(pings, box=BOX).count()


def test_stopped_in_window(pings):
    got = at_speed(pings, 0, window=DAY1).collect()
    assert [(r.bus_line, r.datetime, r.speed) for r in got] == [("0", datetime(2014, 10, 1, 8, 0, 1), 0.0)]


def test_time_extent(pings):
    row = time_extent(pings).first()
    assert row.first_datetime == datetime(2014, 10, 1, 0, 0, 0)
    assert row.last_datetime == datetime(2014, 10, 2, 9, 0, 0)


def test_time_extent_empty(spark, pings):
    row = time_extent(pings.where(F.lit(False))).first()
    assert row.first_datetime is None and row.last_datetime is None
    assert clock_window(pings.where(F.lit(False)), "08:00:00", "17:00:00").is_empty
    assert restrict(pings, window=TimeWindow.empty()).count() == 0


def test_clock_window_is_one_interval(pings):
    w = clock_window(pings, "08:00:05", "08:30:00")
    assert w == TimeWindow(datetime(2014, 10, 1, 8, 0, 5), datetime(2014, 10, 2, 8, 30))
    # 08:00:07 .. 08:00:12 of day 1 (not a daily band: day 2's 09:00 is outside, not because of the clock)
    assert ids(restrict(pings, window=w)) == sorted(["T8", "T9", "T11", "T13", "T14"])


def test_clock_text_checked(pings):
    with pytest.raises(ValueError):
        clock_window(pings, "8h", "17:00:00")
    with pytest.raises(ValueError):
        day_clock_window(1, 2, "08:00", "17:00:00")


def test_day_window_bounds():
    w = day_window(2, 5)
    assert w == TimeWindow(datetime(2014, 10, 2), datetime(2014, 10, 5))
    first, last = day_window("3", "3").day_range()
    assert first > last  # equal days: no calendar day can hold a row
    assert day_window(1, 2, year=2024, month=1).start == datetime(2024, 1, 1)


def test_equal_days_select_nothing(pings):
    assert restrict(pings, window=day_window(1, 1)).count() == 0


def test_day_clock_window_argument_order():
    w = day_clock_window(2, 5, "15:43:20", "17:44:20")
    assert w.start == datetime(2014, 10, 2, 15, 43, 20)
    assert w.end == datetime(2014, 10, 5, 17, 44, 20)
    assert day_clock_window(2, 5, time(1, 2, 3), "00:00:00").start.time() == time(1, 2, 3)


def test_window_partition_days():
    assert day_window(1, 3).day_range()[1].day == 2
    assert day_clock_window(1, 3, "00:00:00", "00:00:01").day_range()[1].day == 3


def test_clock_window_file_order_extent(pings):
    # The last line of the file is a day-1 row, although a day-2 row comes before it.
    w = clock_window(pings, "08:00:00", "09:00:00", extent="file_order")
    assert w == TimeWindow(datetime(2014, 10, 1, 8), datetime(2014, 10, 1, 9))
    assert clock_window(pings, "08:00:00", "09:00:00").end == datetime(2014, 10, 2, 9)
    with pytest.raises(ValueError):
        clock_window(pings, "08:00:00", "09:00:00", extent="nope")


def test_file_order_extent_follows_file_names_not_sizes(spark):
    from transitlens import load_pings

    base = scratch_path(spark, "file-order")
    # The later day's file is larger, so Spark reads it first; input order is still by name.
    write_lines(spark, base + "/2014-10-01.txt", ["10-01-2014,08:00:00,A,1,-22.85,-43.25,5.0"])
    write_lines(spark, base + "/2014-10-02.txt", [
        f"10-02-2014,09:00:{i:02d},B{i},1,-22.85,-43.25,5.0" for i in range(50)
    ] + ["10-03-2014,23:00:00,Z,1,-22.85,-43.25,5.0"])
    pings = load_pings(spark, [base + "/2014-10-01.txt", base + "/2014-10-02.txt"])
    w = clock_window(pings, "08:00:00", "09:00:00", extent="file_order")
    assert w == TimeWindow(datetime(2014, 10, 1, 8), datetime(2014, 10, 3, 9))
    assert pings.head().bus_id != "A"  # head() alone would start in the larger file


def test_box_accepts_any_real_number_but_not_nan_or_bool():
    from decimal import Decimal

    assert Box(Decimal("-43.2"), -43.3, -22.8, -22.9).east == -43.2
    for bad in (float("nan"), True, "x"):
        with pytest.raises(ValueError):
            Box(bad, -43.3, -22.8, -22.9)
