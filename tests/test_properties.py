"""Property tests: random small ping tables (values placed on and around every bound)
against a brute-force Python model of the same rules."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from transitlens import (
    PING_SCHEMA,
    Box,
    TimeWindow,
    at_speed,
    faster_than,
    line_mean,
    restrict,
    slower_than,
    speed_stats,
)
from transitlens.plans.report import ReportSpec, report

BOX = Box(east=-43.2, west=-43.3, north=-22.8, south=-22.9)
T0 = datetime(2014, 10, 1, 8, 0, 0)
WINDOW = TimeWindow(T0, T0 + timedelta(seconds=4))

lats = st.sampled_from([-22.95, -22.9, -22.85, -22.8, -22.75, None])
lons = st.sampled_from([-43.35, -43.3, -43.25, -43.2, -43.15, None])
speeds = st.sampled_from([-1.0, 0.0, 5.5, 10.0, 33.25, 50.0, 75.0, 100.0, 120.0])
times = st.one_of(st.none(), st.integers(-1, 5).map(lambda s: T0 + timedelta(seconds=s)))
rows = st.lists(
    st.tuples(st.sampled_from(["a", "b", "0", "302.0"]), st.sampled_from(["L1", "L2", ""]),
              lats, lons, speeds, times),
    max_size=25,
)
shapes = st.sampled_from([(BOX, None), (None, WINDOW), (BOX, WINDOW)])
SETTINGS = settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))


def inside(row, box, window) -> bool:
    _, _, lat, lon, _, ts = row
    ok = True
    if box is not None:
        ok = ok and lat is not None and lon is not None
        ok = ok and box.west < lon < box.east and box.south < lat < box.north
    if window is not None:
        ok = ok and ts is not None and window.start < ts < window.end
    return ok


def obs(rows_):
    return sorted(((r[1], r[5], r[4]) for r in rows_), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@SETTINGS
@given(data=rows, shape=shapes, threshold=st.sampled_from([0.0, 10.0, 50.0, 100.0]))
def test_restrict_and_observations(spark, data, shape, threshold):
    box, window = shape
    df = spark.createDataFrame(data, PING_SCHEMA)
    kept = [r for r in data if inside(r, box, window)]
    assert restrict(df, box, window).count() == len(kept)
    slow = got(slower_than(df, threshold, box, window))
    exact = got(at_speed(df, threshold, box, window))
    fast = got(faster_than(df, threshold, box, window))
    assert slow == obs(r for r in kept if r[4] < threshold)
    assert exact == obs(r for r in kept if r[4] == threshold)
    assert fast == obs(r for r in kept if r[4] > threshold)
    assert len(slow) + len(exact) + len(fast) == len(kept)


@SETTINGS
@given(data=rows, shape=shapes)
def test_aggregates(spark, data, shape):
    box, window = shape
    df = spark.createDataFrame(data, PING_SCHEMA)
    kept = [r for r in data if inside(r, box, window)]
    by_line: dict[str, list[float]] = {}
    for r in kept:
        by_line.setdefault(r[1], []).append(r[4])
    means = {r.bus_line: r.mean_speed for r in line_mean(df, box, window).collect()}
    assert means.keys() == by_line.keys()
    for k, v in by_line.items():
        assert means[k] == pytest.approx(sum(v) / len(v), rel=1e-12, abs=1e-12)
    (stats,) = speed_stats(df, box, window).collect()
    s = [r[4] for r in kept]
    if not s:
        assert all(v is None for v in stats)
        return
    mean = sum(s) / len(s)
    assert stats.mean_speed == pytest.approx(mean, rel=1e-12, abs=1e-12)
    assert (stats.min_speed, stats.max_speed) == (min(s), max(s))
    if len(s) == 1:
        assert stats.variance_speed is None and stats.stddev_speed is None
    else:
        var = sum((x - mean) ** 2 for x in s) / (len(s) - 1)
        assert stats.variance_speed == pytest.approx(var, rel=1e-9, abs=1e-9)
        assert stats.stddev_speed == pytest.approx(math.sqrt(var), rel=1e-9, abs=1e-9)


@SETTINGS
@given(data=rows, shape=shapes, spec=st.sampled_from([
    ReportSpec(slow_below=10.0, fast_above=50.0),
    ReportSpec(exact=0.0, fast_above=100.0),
    ReportSpec(slow_below=50.0, exact=33.25, fast_above=10.0),
]))
def test_long_report_sections(spark, data, shape, spec):
    box, window = shape
    df = spark.createDataFrame(data, PING_SCHEMA)
    kept = [r for r in data if inside(r, box, window)]
    long = report(df, box, window, spec).long().collect()
    sections: dict[str, list] = {}
    for r in long:
        sections.setdefault(r.section, []).append(r)
    assert len(sections["stats"]) == 1
    lines = {r[1] for r in kept}
    assert {r.bus_line for r in sections.get("line_means", [])} == lines
    for name, cond in (
        ("slow", lambda x: spec.slow_below is not None and x < spec.slow_below),
        ("exact", lambda x: spec.exact is not None and x == spec.exact),
        ("fast", lambda x: spec.fast_above is not None and x > spec.fast_above),
    ):
        want = obs(r for r in kept if cond(r[4]))
        have = sorted(((r.bus_line, r.datetime, r.speed) for r in sections.get(name, [])), key=str)
        assert have == want, name


MIDNIGHT = datetime(2014, 10, 2)
near_midnight = st.one_of(
    st.none(), st.integers(-3, 3).map(lambda s: MIDNIGHT + timedelta(seconds=s))
)
layout_rows = st.lists(
    st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["L1", "L2"]), lats, lons, speeds,
              near_midnight),
    min_size=1, max_size=20,
)
midnight_windows = st.sampled_from([
    TimeWindow(MIDNIGHT - timedelta(seconds=2), MIDNIGHT),  # ends exactly at midnight
    TimeWindow(MIDNIGHT, MIDNIGHT + timedelta(seconds=2)),  # starts exactly at midnight
    TimeWindow(MIDNIGHT - timedelta(seconds=2), MIDNIGHT + timedelta(seconds=2)),
    TimeWindow(MIDNIGHT, MIDNIGHT),
])


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(data=layout_rows, window=midnight_windows, with_box=st.booleans())
def test_day_pruning_never_loses_rows(spark, data, window, with_box):
    from transitlens import load_partitioned, write_partitioned
    from transitlens.schema import PING_COLUMNS
    from transitlens.session import scratch_path

    df = spark.createDataFrame(data, PING_SCHEMA)
    layout = load_partitioned(spark, write_partitioned(df, scratch_path(spark, "prop-layout")))
    box = BOX if with_box else None
    want = got(restrict(df, box, window))
    have = got(restrict(layout, box, window).select(*PING_COLUMNS))
    assert have == want
    assert want == sorted((tuple(r) for r in data if inside(r, box, window)), key=str)


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=list(HealthCheck))
@given(data=layout_rows, n=st.integers(1, 25))
def test_pruned_preview_equals_full_preview(spark, data, n):
    from transitlens import load_partitioned, preview, write_partitioned
    from transitlens.schema import PING_COLUMNS
    from transitlens.session import scratch_path

    order = ["datetime", "bus_line", "speed", "bus_id", "latitude", "longitude"]
    df = spark.createDataFrame(data, PING_SCHEMA)
    layout = load_partitioned(spark, write_partitioned(df, scratch_path(spark, "prop-prev")))
    have = [tuple(r) for r in preview(layout, n, order).select(*PING_COLUMNS).collect()]
    want = [tuple(r) for r in preview(df, n, order).select(*PING_COLUMNS).collect()]
    assert have == want
