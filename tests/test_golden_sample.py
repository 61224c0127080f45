"""Golden numbers on the 255-row sample of real pings (FIXTURES.md part 4),
where TRANSITLENS_SAMPLE names it; test_golden_small.py covers the same shapes everywhere.

The sample is only read as input data; nothing of the original program is run."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from transitlens import (
    Box,
    TimeWindow,
    at_speed,
    day_clock_window,
    faster_than,
    full_report,
    line_mean,
    load_pings,
    restrict,
    slower_than,
    speed_stats,
    time_extent,
)

SAMPLE = os.environ.get("TRANSITLENS_SAMPLE")  # collected only where it is set (conftest.py)

EVERYWHERE = Box(east=0.0, west=-180.0, north=0.0, south=-90.0)
BOX = Box.from_args(-43.2, -43.3, -22.85, -22.95)
WINDOW = TimeWindow(datetime(2014, 10, 4, 0, 0, 6), datetime(2014, 10, 4, 0, 0, 9))
INVOCATION_BOX = Box.from_args(-43.24, -43.26, -22.875, -22.9)
TOL = dict(rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def sample(spark):
    return load_pings(spark, SAMPLE).cache()


def test_row_counts_per_second(sample):
    assert sample.count() == 255
    assert sample.select(F.countDistinct("bus_id")).first()[0] == 255
    assert sample.select(F.countDistinct("bus_line")).first()[0] == 103
    per_second = sample.groupBy(F.second("datetime").alias("s")).count().orderBy("s").collect()
    assert [(r.s, r["count"]) for r in per_second] == [(6, 19), (7, 87), (8, 61), (9, 72), (10, 16)]


def test_extent(sample):
    row = time_extent(sample).first()
    assert row.first_datetime == datetime(2014, 10, 4, 0, 0, 6)
    assert row.last_datetime == datetime(2014, 10, 4, 0, 0, 10)


def test_stats_all_rows(sample):
    r = speed_stats(sample, box=EVERYWHERE).first()
    assert r.mean_speed == pytest.approx(12.641529411764703, **TOL)
    assert r.variance_speed == pytest.approx(434.3104397776747, **TOL)
    assert r.stddev_speed == pytest.approx(20.840116117183097, **TOL)
    assert (r.min_speed, r.max_speed) == (0.0, 90.0)


def test_box(sample):
    inside = restrict(sample, box=BOX)
    assert inside.count() == 50
    assert line_mean(sample, box=BOX).count() == 33
    r = speed_stats(sample, box=BOX).first()
    assert r.mean_speed == pytest.approx(15.0922, **TOL)
    assert r.variance_speed == pytest.approx(488.9300256734694, **TOL)
    assert r.stddev_speed == pytest.approx(22.11176215667737, **TOL)
    assert (r.min_speed, r.max_speed) == (0.0, 70.38)
    assert slower_than(sample, 10, box=BOX).count() == 31
    assert faster_than(sample, 50, box=BOX).count() == 6
    assert at_speed(sample, 0, box=BOX).count() == 19
    assert faster_than(sample, 100, box=BOX).count() == 0


def test_window(sample):
    assert restrict(sample, window=WINDOW).count() == 148
    r = speed_stats(sample, window=WINDOW).first()
    assert r.mean_speed == pytest.approx(12.658445945945946, **TOL)


def test_box_and_window(sample):
    assert restrict(sample, box=BOX, window=WINDOW).count() == 30
    assert line_mean(sample, box=BOX, window=WINDOW).count() == 23
    r = speed_stats(sample, box=BOX, window=WINDOW).first()
    assert r.mean_speed == pytest.approx(15.008666666666667, **TOL)


def test_line_zero(sample):
    means = {r.bus_line: r.mean_speed for r in line_mean(sample, box=EVERYWHERE).collect()}
    assert means["0"] == pytest.approx(6.081100917431194, **TOL)
    assert restrict(sample, box=EVERYWHERE).where(F.col("bus_line") == "0").count() == 109


def test_sample_invocation_box_and_window(sample):
    window = day_clock_window(2, 5, "15:43:20", "17:44:20")
    for w in (None, window):
        r = speed_stats(sample, box=INVOCATION_BOX, window=w).first()
        assert r.mean_speed == pytest.approx(27.59) and r.variance_speed is None
        assert r.stddev_speed is None
        lines = line_mean(sample, box=INVOCATION_BOX, window=w).collect()
        assert [(x.bus_line, x.mean_speed) for x in lines] == [("0", pytest.approx(27.59))]
    rep = full_report(sample, INVOCATION_BOX, 2, 5, "15:43:20", "17:44:20")
    assert rep["stats"].count() == 1
    assert rep["exact"].count() == 0 and rep["fast"].count() == 0
