"""Golden numbers on a small invented day file: the same shapes as on the sample of real pings,
with answers from plain Python over the listed values."""

from __future__ import annotations

import statistics
from datetime import datetime

import pytest
from helpers import write_lines

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
from transitlens.session import scratch_path

# second of the day, bus, line, latitude, longitude, speed
PINGS = [
    (6, "A1", "0", -22.90, -43.25, 0.0),
    (6, "A2", "485", -22.91, -43.21, 31.5),
    (7, "A3", "0", -22.86, -43.29, 4.25),
    (7, "A4", "", -22.70, -43.25, 60.0),
    (7, "A5", "485.0", -22.88, -43.26, 27.59),
    (8, "A6", "0", -22.89, -43.22, 51.0),
    (8, "A7", "232", -22.94, -43.28, 10.0),
    (8, "A8", "232", -22.95, -43.28, 9.99),
    (9, "A9", "232", -22.87, -43.20, 110.0),
    (9, "B1", "0", -22.87, -43.27, 119.0),
    (9, "B2", "485", -22.92, -43.24, 120.0),
    (10, "B3", "485", -22.93, -43.23, 120.5),
    (10, "B4", "0", -22.85, -43.25, 70.38),
]
KEPT = [p for p in PINGS if p[5] <= 120]
EVERYWHERE = Box(east=0.0, west=-180.0, north=0.0, south=-90.0)
BOX = Box.from_args(-43.2, -43.3, -22.85, -22.95)
INSIDE = [p for p in KEPT if -43.3 < p[4] < -43.2 and -22.95 < p[3] < -22.85]
WINDOW = TimeWindow(datetime(2014, 10, 4, 0, 0, 6), datetime(2014, 10, 4, 0, 0, 9))
DURING = [p for p in KEPT if 6 < p[0] < 9]
TOL = dict(rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def pings(spark):
    lines = [f"10-04-2014,00:00:{s:02d},{bus},{line},{lat},{lon},{v}" for s, bus, line, lat, lon, v in PINGS]
    return load_pings(spark, write_lines(spark, scratch_path(spark, "golden-small"), lines)).cache()


def check_stats(row, want):
    speeds = [p[5] for p in want]
    assert row.mean_speed == pytest.approx(statistics.fmean(speeds), **TOL)
    assert row.variance_speed == pytest.approx(statistics.variance(speeds), **TOL)
    assert row.stddev_speed == pytest.approx(statistics.stdev(speeds), **TOL)
    assert (row.min_speed, row.max_speed) == (min(speeds), max(speeds))


def test_counts_and_extent(pings):
    assert pings.count() == len(KEPT) == 12 and len(INSIDE) == 8 and len(DURING) == 6
    row = time_extent(pings).first()
    assert row.first_datetime == datetime(2014, 10, 4, 0, 0, 6)
    assert row.last_datetime == datetime(2014, 10, 4, 0, 0, 10)


@pytest.mark.parametrize(
    "box, window, want",
    [
        (EVERYWHERE, None, KEPT),
        (BOX, None, INSIDE),
        (None, WINDOW, DURING),
        (BOX, WINDOW, [p for p in INSIDE if p in DURING]),
    ],
)
def test_every_restriction(pings, box, window, want):
    assert {r.bus_id for r in restrict(pings, box, window).collect()} == {p[1] for p in want}
    check_stats(speed_stats(pings, box=box, window=window).first(), want)
    means = {r.bus_line: r.mean_speed for r in line_mean(pings, box=box, window=window).collect()}
    lines = {p[2] for p in want}
    assert means == {n: pytest.approx(statistics.fmean(p[5] for p in want if p[2] == n), **TOL) for n in lines}
    for found, test in (
        (slower_than(pings, 10, box=box, window=window), lambda v: v < 10),
        (faster_than(pings, 50, box=box, window=window), lambda v: v > 50),
        (at_speed(pings, 0, box=box, window=window), lambda v: v == 0),
    ):
        assert sorted(r.speed for r in found.collect()) == sorted(p[5] for p in want if test(p[5]))


def test_full_report_of_one_row(pings):
    box = Box.from_args(-43.255, -43.265, -22.875, -22.885)
    only = speed_stats(pings, box=box, window=day_clock_window(2, 5, "15:43:20", "17:44:20")).first()
    assert only.mean_speed == pytest.approx(27.59) and only.variance_speed is None and only.stddev_speed is None
    rep = full_report(pings, box, 2, 5, "15:43:20", "17:44:20")
    assert rep["stats"].count() == 1 and rep["exact"].count() == 0 and rep["fast"].count() == 0
