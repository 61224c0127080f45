"""Extent and preview learn the days from the folder names: files of other days stay closed."""

from __future__ import annotations

import os
from datetime import date, datetime
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from transitlens import clock_window, load_partitioned, preview, time_extent, write_partitioned
from transitlens.functions.predicates import day_is_known, growing_groups, layout_days
from transitlens.operators.extent import extent_days
from transitlens.schema import PING_COLUMNS, SERVICE_DATE

ORDER = ["datetime", "bus_id"]


@pytest.fixture
def rows(spark):
    """Three pings a day, 1 to 9 March, none on the 5th."""
    data = [
        (f"b{d}{h}", "7", -22.9, -43.3, float(h), datetime(2021, 3, d, h))
        for d in range(1, 10)
        if d != 5
        for h in (6, 12, 18)
    ]
    return spark.createDataFrame(data, "bus_id string, bus_line string, latitude double, longitude double, speed double, datetime timestamp_ntz")


@pytest.fixture
def base(rows, scratch):
    return write_partitioned(rows.coalesce(1), scratch("listing"))


def local(path: str) -> str:
    return urlparse(path).path


def spoil(base: str, *days: int) -> None:
    """Files of these days can no longer be read, not even their footers."""
    for d in days:
        folder = os.path.join(local(base), f"{SERVICE_DATE}=2021-03-{d:02d}")
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"not a Parquet file")
                crc = os.path.join(folder, f".{name}.crc")
                if os.path.exists(crc):
                    os.remove(crc)


def plain(df):
    return [r.bus_id for r in df.select("bus_id").collect()]


def test_extent_opens_the_first_and_last_day_only(spark, base, rows):
    spoil(base, 2, 3, 4, 6, 7, 8)
    pings = load_partitioned(spark, base)
    assert extent_days(pings) == (date(2021, 3, 1), date(2021, 3, 9))
    assert tuple(time_extent(pings).first()) == (datetime(2021, 3, 1, 6), datetime(2021, 3, 9, 18))
    window = clock_window(pings, "07:00:00", "13:00:00")
    assert (window.start, window.end) == (datetime(2021, 3, 1, 7), datetime(2021, 3, 9, 13))
    with pytest.raises(Exception, match="(?i)parquet"):
        pings.agg(F.min(SERVICE_DATE)).first()


def test_preview_opens_as_many_days_as_it_needs(spark, base, rows):
    spoil(base, 4, 6, 7, 8, 9)
    pings = load_partitioned(spark, base)
    want = plain(rows.orderBy(*ORDER))
    for n in (1, 3, 4, 9):
        assert plain(preview(pings, n, ORDER)) == want[:n]
    with pytest.raises(Exception, match="(?i)parquet"):
        preview(pings, 10, ORDER).collect()


def test_days_without_rows_are_passed_over(spark, base, rows):
    """Folders whose files hold no row, at both ends and inside, and a folder without files."""
    for day in ("2021-01-01", "2021-02-28", "2021-03-05", "2021-03-10", "2022-01-01"):
        rows.limit(0).coalesce(1).write.parquet(f"{base}/{SERVICE_DATE}={day}")
    os.makedirs(os.path.join(local(base), f"{SERVICE_DATE}=2030-01-01"))
    pings = load_partitioned(spark, base)
    assert layout_days(pings)[:2] == [date(2021, 1, 1), date(2021, 2, 28)]
    assert date(2030, 1, 1) not in layout_days(pings)
    assert extent_days(pings) == (date(2021, 3, 1), date(2021, 3, 9))
    assert plain(preview(pings, 5, ORDER)) == plain(rows.orderBy(*ORDER))[:5]
    assert plain(preview(pings, 100, ORDER)) == plain(rows.orderBy(*ORDER))


def test_filtered_and_empty_frames(spark, base, rows, scratch):
    pings = load_partitioned(spark, base)
    late = pings.where("datetime > TIMESTAMP_NTZ '2021-03-06 10:00:00' AND speed > 6")
    assert day_is_known(late)
    assert extent_days(late) == (date(2021, 3, 6), date(2021, 3, 9))
    assert plain(preview(late, 3, ORDER)) == ["b612", "b618", "b712"]
    none = pings.where("speed > 1000")
    assert extent_days(none) == (None, None) and tuple(time_extent(none).first()) == (None, None)
    assert plain(preview(none, 3, ORDER)) == []
    empty = load_partitioned(spark, write_partitioned(rows.limit(0), scratch("empty")))
    assert extent_days(empty) == (None, None) and plain(preview(empty, 3, ORDER)) == []


def test_rows_without_a_time_come_first(spark, rows, scratch):
    undated = rows.limit(2).withColumn("datetime", F.lit(None).cast("timestamp_ntz"))
    pings = load_partitioned(spark, write_partitioned(rows.union(undated), scratch("undated")))
    assert layout_days(pings)[0] is None
    assert extent_days(pings) == (date(2021, 3, 1), date(2021, 3, 9))
    got = preview(pings, 3, ORDER).select(*PING_COLUMNS).collect()
    assert [r.datetime for r in got] == [None, None, datetime(2021, 3, 1, 6)]
    assert [r.datetime for r in preview(pings, 2, ORDER).collect()] == [None, None]


def test_a_single_day_folder_is_no_layout(spark, base):
    """Read by itself, a day folder has no partition column; nothing is pruned by it."""
    one = load_partitioned(spark, f"{base}/{SERVICE_DATE}=2021-03-02")
    assert not day_is_known(one)
    assert tuple(time_extent(one).first()) == (datetime(2021, 3, 2, 6), datetime(2021, 3, 2, 18))
    assert one.count() == preview(one, 20, ORDER).count() == 3


def test_groups_grow():
    days = [date(2021, 1, d) for d in range(1, 12)]
    assert [len(g) for g in growing_groups(days)] == [1, 2, 4, 4]
    assert [d for g in growing_groups(days) for d in g] == days
