"""Order and choice of day files, the text writer's limits, and the layout of unordered input."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from helpers import write_lines
from pyspark.sql import functions as F

from transitlens import (
    TimeWindow,
    clock_window,
    load_partitioned,
    load_pings,
    restrict,
    window_paths,
    write_day_files,
    write_partitioned,
)
from transitlens.__main__ import build_report, parse_args
from transitlens.sources.events import load_event_pings

CLOCK = ("08:00:00", "09:00:00")


@pytest.fixture
def two_days(spark, scratch):
    base = scratch("two days")  # a space, since paths are encoded
    write_lines(spark, base + "/31-10-2014.txt", ["10-31-2014,08:30:00,A,1,-22.85,-43.25,5.0"])
    write_lines(spark, base + "/01-11-2014.txt", [f"11-01-2014,08:{i:02d}:00,B,1,-22.85,-43.25,5.0" for i in range(9)])
    return [base + "/31-10-2014.txt", base + "/01-11-2014.txt"]


@pytest.mark.parametrize("strict", [False, True])
def test_file_order_follows_the_listed_order(spark, two_days, strict):
    w = clock_window(load_pings(spark, two_days, strict=strict), *CLOCK, extent="file_order")
    assert w == TimeWindow(datetime(2014, 10, 31, 8), datetime(2014, 11, 1, 9))
    w = clock_window(load_pings(spark, two_days[::-1]), *CLOCK, extent="file_order")
    assert w == TimeWindow(datetime(2014, 11, 1, 8), datetime(2014, 10, 31, 9))


def test_file_order_of_no_rows_is_the_empty_window(spark, two_days):
    pings = load_pings(spark, two_days, max_speed=-1.0)
    assert clock_window(pings, *CLOCK, extent="file_order").is_empty


def test_file_order_is_refused_without_an_input_order(spark, two_days, scratch):
    pings = load_pings(spark, two_days)
    layout = load_partitioned(spark, write_partitioned(pings, scratch("order")))
    for frame in (layout, pings.union(pings), spark.createDataFrame(pings.collect(), pings.schema)):
        with pytest.raises(ValueError, match="one scan"):
            clock_window(frame, *CLOCK, extent="file_order")
    kept = pings.cache()
    with pytest.raises(ValueError, match="uncached"):
        clock_window(kept, *CLOCK, extent="file_order")
    kept.unpersist()


def test_a_window_chooses_its_day_files(spark, scratch):
    pings = load_event_pings(spark, "/root/testdata/sf0.001")
    template = write_day_files(pings, scratch("days")) + "/day=%Y-%m-%d"
    window = TimeWindow(datetime(2024, 1, 5, 12), datetime(2024, 1, 7))
    paths = window_paths(template, window)
    assert [p[-10:] for p in paths] == ["2024-01-05", "2024-01-06"]
    got = restrict(load_pings(spark, paths), window=window)
    assert {f.split("/")[-2] for f in got.inputFiles()} == {"day=2024-01-05", "day=2024-01-06"}
    assert got.count() == restrict(pings, window=window).count() > 0
    assert window_paths(template, TimeWindow.empty()) == []


@pytest.mark.parametrize("bad", ["B,1", "B\n1", "B\r1"])
def test_the_text_writer_refuses_what_lines_cannot_hold(spark, two_days, scratch, bad):
    pings = load_pings(spark, two_days)
    for name in ("bus_id", "bus_line"):
        with pytest.raises(Exception, match=f"{name} holds a comma or a line break"):
            write_day_files(pings.withColumn(name, F.lit(bad)), scratch("bad"))


def files_by_day(df):
    return Counter(f.split("ping_layout_day=")[1][:10] for f in df.inputFiles())


def test_unordered_input_gives_a_file_per_day(spark, scratch):
    pings = load_event_pings(spark, "/root/testdata/sf0.1").repartition(16)
    layout = load_partitioned(spark, write_partitioned(pings, scratch("by-day"), by_day=True))
    files = files_by_day(layout)
    assert len(files) >= 30 and sum(files.values()) <= len(files) + 5
    plain = pings.select(*[F.xxhash64(*pings.columns).alias("h")])
    again = layout.select(*[F.xxhash64(*pings.columns).alias("h")])
    assert again.count() == plain.count() and again.exceptAll(plain).isEmpty()


def test_a_hot_day_is_split(spark, scratch):
    pings = load_event_pings(spark, "/root/testdata/sf0.1")
    hot = F.when(F.col("bus_id").cast("long") % 3 == 0, F.lit("2024-01-09 10:00:00").cast("timestamp_ntz"))
    pings = pings.withColumn("datetime", F.coalesce(hot, "datetime")).repartition(16)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "128k")
    try:
        layout = load_partitioned(spark, write_partitioned(pings, scratch("hot-day"), by_day=True))
    finally:
        spark.conf.set(size, before)
    assert files_by_day(layout)["2024-01-09"] > 2
    assert layout.count() == pings.count()


def test_one_way_to_arrange_the_layout(spark, two_days, scratch):
    with pytest.raises(ValueError, match="not both"):
        write_partitioned(load_pings(spark, two_days), scratch("both"), compact=True, by_day=True)


def test_the_month_needs_days(spark, two_days):
    with pytest.raises(SystemExit, match="--days"):
        build_report(spark, parse_args([*two_days, "--clock", *CLOCK, "--month", "11"]))
