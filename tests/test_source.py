"""Sources: raw day files to the clean ping table (S1-S5, P1-P5, F1) on hand-made rows."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from helpers import write_lines
from pyspark.sql import functions as F

from transitlens import PING_SCHEMA, day_paths, load_pings, write_day_files
from transitlens.functions.columns import compose_datetime, parse_datetime, truncate_to_second
from transitlens.sources.text import read_raw, split_lines, to_lines

# Hand-made rows (FIXTURES.md part 3).
ROWS = [
    "10-01-2014,08:00:00,T1,10.0,-22.85,-43.25,35.5",
    "10-01-2014,08:00:01,T2,0,-22.85,-43.25,0.0",
    "10-01-2014,08:00:02,T3,XY1,-22.85,-43.25,12.0",
    "10-01-2014,08:00:03,T4,10.0,-22.85,-43.25,120.0",
    "10-01-2014,08:00:04,T5,10.0,-22.85,-43.25,120.01",
    "10-01-2014,08:00:05,T6,10.0,-22.85,-43.25,abc",
    "10-01-2014,08:00:06,T7,10.0,-22.85,-43.25,NaN",
    "10-01-2014,08:00:07,T8,10.0,-22.85,-43.25,-1.0",
    "10-01-2014,08:00:08,T9,10.0,-22.80,-43.20,20.0",
    "10-01-2014,00:00:00,T10,10.0,-22.85,-43.25,20.0",
    "10-01-2014,08:00:09,T11,10.0,?,-43.25,20.0",
    "10-01-2014,8h,T12,10.0,-22.85,-43.25,20.0",
    "10-01-2014,08:00:10",
    "",
    "10-01-2014,08:00:11,T13,10.0,-22.85,-43.25,20.0,extra",
    "10-01-2014,08:00:12,T14,,-22.85,-43.25,20.0",
    "10-02-2014,09:00:00,T1,10.0,-22.85,-43.25,45.0",
    "10-01-2014,08:00:00,T1,10.0,-22.85,-43.25,35.5",
]
KEPT = ["T1", "T1", "T1", "T2", "T3", "T4", "T8", "T9", "T10", "T11", "T12", "T13", "T14"]


@pytest.fixture(scope="module")
def edge_file(spark, tmp_path_factory):
    from transitlens.session import scratch_path

    return write_lines(spark, scratch_path(spark, "edge-rows"), ROWS)


@pytest.fixture(scope="module")
def edge_pings(spark, edge_file):
    return load_pings(spark, edge_file)


def test_schema_is_declared(edge_pings):
    got = [(f.name, f.dataType) for f in edge_pings.schema]
    assert got == [(f.name, f.dataType) for f in PING_SCHEMA]


def test_outliers_and_bad_rows_dropped(edge_pings):
    ids = sorted(r.bus_id for r in edge_pings.collect())
    assert ids == sorted(KEPT)


def test_values_typed(edge_pings):
    rows = {r.bus_id: r for r in edge_pings.where(F.col("bus_id") != "T1").collect()}
    assert rows["T2"].bus_line == "0" and rows["T2"].speed == 0.0
    assert rows["T3"].bus_line == "XY1"
    assert rows["T4"].speed == 120.0
    assert rows["T8"].speed == -1.0
    assert rows["T11"].latitude is None and rows["T11"].datetime == datetime(2014, 10, 1, 8, 0, 9)
    assert rows["T12"].datetime is None and rows["T12"].latitude == -22.85
    assert rows["T13"].speed == 20.0 and rows["T13"].datetime == datetime(2014, 10, 1, 8, 0, 11)
    assert rows["T14"].bus_line == ""
    assert rows["T10"].datetime == datetime(2014, 10, 1, 0, 0, 0)


def test_line_stays_text(edge_pings):
    lines = {r.bus_line for r in edge_pings.collect()}
    assert "10.0" in lines and "10" not in lines


def test_duplicates_kept(edge_pings):
    day1 = edge_pings.where(
        (F.col("bus_id") == "T1") & (F.col("datetime") == F.lit("2014-10-01 08:00:00").cast("timestamp_ntz"))
    )
    assert day1.count() == 2


def test_quote_is_plain_character(spark, scratch):
    path = write_lines(spark, scratch("quote"), ['10-01-2014,08:00:00,"Q1",7"x,-22.85,-43.25,5.0'])
    row = load_pings(spark, path).first()
    assert row.bus_id == '"Q1"' and row.bus_line == '7"x'


def test_strict_mode_fails_on_short_row(spark, edge_file):
    with pytest.raises(Exception, match="fewer than 7 fields"):
        load_pings(spark, edge_file, strict=True).select("bus_line").collect()


def test_strict_mode_matches_default_on_good_rows(spark, scratch):
    good = [r for r in ROWS if r.count(",") >= 6]
    path = write_lines(spark, scratch("good"), good)
    a = sorted(map(tuple, load_pings(spark, path).collect()), key=str)
    b = sorted(map(tuple, load_pings(spark, path, strict=True).collect()), key=str)
    assert a == b


def test_text_line_parser_equals_csv_reader(spark, edge_file):
    a = read_raw(spark, edge_file)
    b = split_lines(spark.read.text(edge_file))
    rows_a = sorted(map(tuple, a.collect()), key=str)
    rows_b = sorted(map(tuple, b.collect()), key=str)
    # The CSV reader reads an empty field as null; the splitter keeps the empty string.
    norm = lambda rows: [tuple(None if v == "" else v for v in r) for r in rows]
    fix_nan = lambda rows: [tuple("nan" if isinstance(v, float) and v != v else v for v in r) for r in rows]
    assert fix_nan(norm(rows_a)) == fix_nan(norm(rows_b))


def test_round_trip_through_text(spark, edge_pings, scratch):
    path = scratch("round-trip")
    to_lines(edge_pings).write.text(path)
    back = load_pings(spark, path)
    key = lambda r: str(tuple(r))
    assert sorted(back.collect(), key=key) == sorted(edge_pings.collect(), key=key)


def test_day_paths():
    paths = day_paths("/data/2014-10-%d.txt", date(2014, 10, 1), date(2014, 10, 3))
    assert paths == ["/data/2014-10-01.txt", "/data/2014-10-02.txt", "/data/2014-10-03.txt"]
    assert day_paths("/x/%Y-%m-%d", date(2014, 10, 3), date(2014, 10, 1)) == []


def test_day_union_equals_single_read(spark, edge_pings, scratch):
    base = write_day_files(edge_pings, scratch("days"))
    both = load_pings(spark, day_paths(base + "/day=%Y-%m-%d", date(2014, 10, 1), date(2014, 10, 2)))
    only_first = load_pings(spark, day_paths(base + "/day=%Y-%m-%d", date(2014, 10, 1), date(2014, 10, 1)))
    dated = edge_pings.where(F.col("datetime").isNotNull())
    assert both.count() == dated.count()
    assert only_first.count() == dated.where(F.col("datetime") < F.lit("2014-10-02").cast("timestamp_ntz")).count()


def test_parse_datetime_rejects_junk_without_error(spark):
    df = spark.createDataFrame(
        [("10-04-2014 00:00:06",), ("13-45-2014 00:00:00",), ("8h",), (None,)], "s string"
    )
    got = [r[0] for r in df.select(parse_datetime(F.col("s"))).collect()]
    assert got == [datetime(2014, 10, 4, 0, 0, 6), None, None, None]


def test_compose_datetime_null_part_gives_null(spark):
    df = spark.createDataFrame([("10-04-2014", None), ("10-04-2014", "01:02:03")], "d string, t string")
    got = [r[0] for r in df.select(compose_datetime(F.col("d"), F.col("t"))).collect()]
    assert got == [None, datetime(2014, 10, 4, 1, 2, 3)]


def test_datetime_is_wall_clock_in_any_session_zone(spark, edge_file):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        # 2014-10-19 00:30 does not exist in Sao Paulo (daylight-saving gap).
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        df = spark.createDataFrame([("10-19-2014", "00:30:00")], "d string, t string")
        got = df.select(compose_datetime(F.col("d"), F.col("t"))).first()[0]
        assert got == datetime(2014, 10, 19, 0, 30)
        ts = spark.createDataFrame([(datetime(2014, 10, 19, 0, 30, 5, 999),)], "ts timestamp_ntz")
        assert ts.select(truncate_to_second(F.col("ts"))).first()[0] == datetime(2014, 10, 19, 0, 30, 5)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_backslash_is_plain_character(spark, scratch):
    line = "10-01-2014,08:00:00,B\\1,L\\,-22.85,-43.25,5.0"
    path = write_lines(spark, scratch("backslash"), [line])
    row = load_pings(spark, path).first()
    fields = line.split(",")
    assert (row.bus_id, row.bus_line, row.speed) == (fields[2], fields[3], 5.0)


def test_windows_line_endings(spark, scratch):
    import os

    folder = scratch("crlf")
    os.makedirs(folder.replace("file:", ""), exist_ok=True)
    with open(os.path.join(folder.replace("file:", ""), "day.txt"), "wb") as fh:
        fh.write(b"10-01-2014,08:00:00,T1,10.0,-22.85,-43.25,35.5\r\n"
                 b"10-01-2014,08:00:01,T2,0,-22.85,-43.25,0.0\r\n")
    for strict in (False, True):
        rows = sorted(load_pings(spark, folder, strict=strict).collect(), key=lambda r: r.bus_id)
        assert [(r.bus_id, r.speed) for r in rows] == [("T1", 35.5), ("T2", 0.0)]


def test_gzip_day_file(spark, scratch):
    import gzip
    import os

    folder = scratch("gzip").replace("file:", "")
    os.makedirs(folder, exist_ok=True)
    with gzip.open(os.path.join(folder, "2014-10-01.txt.gz"), "wb") as fh:
        fh.write(("\n".join(ROWS) + "\n").encode())
    got = sorted(r.bus_id for r in load_pings(spark, folder).collect())
    assert got == sorted(KEPT)
    # The strict reader decompresses the same way (well-formed lines only).
    strict_folder = scratch("gzip-strict").replace("file:", "")
    os.makedirs(strict_folder, exist_ok=True)
    good = [r for r in ROWS if r.count(",") >= 6]
    with gzip.open(os.path.join(strict_folder, "2014-10-01.txt.gz"), "wb") as fh:
        fh.write(("\n".join(good) + "\n").encode())
    assert load_pings(spark, strict_folder, strict=True).count() == len(KEPT)
