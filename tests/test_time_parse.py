"""The timestamp parse gives what the formatter alone gives, in any session zone."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transitlens.functions.columns import compose_datetime, parse_datetime
from transitlens.schema import DATETIME_FORMAT

digit = st.sampled_from("0123456789")
usual = st.builds(
    lambda mo, d, y, h, mi, s: f"{mo:02d}-{d:02d}-{y:04d} {h:02d}:{mi:02d}:{s:02d}",
    st.integers(0, 13), st.integers(0, 32), st.sampled_from([0, 1, 1582, 1900, 2014, 2016, 9999]),
    st.integers(0, 25), st.integers(0, 61), st.integers(0, 61),
)
odd = st.sampled_from(
    ["", " ", "10-01-2014", "1-1-2014 1:1:1", "10-01-2014 00:00:00\\n", "10-01-2014 00:00:00 ", " 10-01-2014 00:00:00",
     "10-01-+12014 00:00:00", "10-01--0001 00:00:00", "10-01-12014 00:00:00", "10-01-2014T00:00:00", "+1-01-2014 00:00:00",
     "10-01-2014 00:00:00.5", "10-01-2014 00:00:00Z", "٠١-01-2014 00:00:00", "02-29-2015 10:00:00", "02-29-2016 10:00:00"]
)


def formatter(text):
    fmt = F.lit(DATETIME_FORMAT)
    return F.when(F.try_to_timestamp(text, fmt).isNotNull(), F.to_timestamp_ntz(text, fmt))


@settings(max_examples=15, phases=[Phase.generate], deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.one_of(usual, usual, odd, st.text(digit, max_size=20)), min_size=1, max_size=60))
def test_equals_the_formatter(spark, texts):
    df = spark.createDataFrame([(t.replace("\\n", "\n"),) for t in [*texts, ""]] + [(None,)], "t string")
    rows = df.select("t", parse_datetime(F.col("t")).cast("string").alias("a"), formatter(F.col("t")).cast("string").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    # the same from two columns, cut at any place that leaves a blank between them
    two = df.where("t IS NULL OR t LIKE '% %'").select(
        compose_datetime(F.expr("substring(t, 1, locate(' ', t) - 1)"), F.expr("substring(t, locate(' ', t) + 1)")).cast("string").alias("a"),
        formatter(F.col("t")).cast("string").alias("b"),
    ).collect()
    assert [r.a for r in two] == [r.b for r in two]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Kathmandu"])
def test_hours_in_a_gap_are_wall_clock(spark, zone):
    """The first hours of 19 October 2014 do not exist in Sao Paulo."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("10-19-2014", "00:30:00"), ("10-19-2014", "24:00:00"), (None, "00:30:00")], "d string, t string")
        got = [r[0] for r in df.select(compose_datetime(F.col("d"), F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [datetime(2014, 10, 19, 0, 30), None, None]


def test_other_formats_go_through_the_formatter(spark):
    df = spark.createDataFrame([("2014/10/19 5",), ("x",)], "t string")
    got = [r[0] for r in df.select(parse_datetime(F.col("t"), "yyyy/MM/dd H")).collect()]
    assert got == [datetime(2014, 10, 19, 5), None]
