"""Scalar column expressions. All are built-in Catalyst expressions (codegen, no Python)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, functions as F

from transitlens.schema import DATETIME_FORMAT


# The two parts of DATETIME_FORMAT with all digits written out.
_DATE_SHAPE, _TIME_SHAPE = "[0-9]{2}-[0-9]{2}-[0-9]{4}", "[0-9]{2}:[0-9]{2}:[0-9]{2}"


def ntz_literal(value: datetime | str) -> Column:
    """A ``TIMESTAMP_NTZ`` literal.

    Built from text and cast, so it is independent of the session time zone and of
    ``spark.sql.timestampType``; constant folding turns it into a plain literal that the
    Parquet scan can push down.
    """
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def date_literal(value: date | str) -> Column:
    if isinstance(value, datetime):
        value = value.date()
    if isinstance(value, date):
        value = value.isoformat()
    return F.lit(value).cast("date")


def parse_datetime(text: Column, fmt: str = DATETIME_FORMAT) -> Column:
    """Parse ``text`` with ``fmt`` into a ``TIMESTAMP_NTZ``; unparsable or null text gives null.

    ``to_timestamp_ntz`` raises on bad text under ANSI mode, so it only runs behind a
    ``try_to_timestamp`` validity check of the same pattern (the pattern has no zone, so
    "parses as a zoned timestamp" and "parses as a local one" accept the same strings).
    The result is the wall-clock time of the text whatever the session zone, including
    times that fall in a daylight-saving gap.

    Text of the usual shape in the library's own format (``DATETIME_FORMAT``) is taken apart by
    position instead, which gives the same times and refuses the same texts; any other text goes
    through the formatter. ``tools/time_parse.py`` times the forms. On 10 million rows (8 cores)
    two formatter parses took 4.3 s, one zoned parse moved to wall-clock time 3.8 s, the digit
    groups behind a regular expression 2.9 s, and behind a character map 4.6 s.
    """
    if fmt != DATETIME_FORMAT:
        return _formatted(text, fmt)
    usual = text.rlike(rf"^{_DATE_SHAPE} {_TIME_SHAPE}\z")
    return F.when(usual, _by_position(text, text, 12)).otherwise(_formatted(text, fmt))


def _formatted(text: Column, fmt: str) -> Column:
    fmt_col = F.lit(fmt)
    return F.when(
        F.try_to_timestamp(text, fmt_col).isNotNull(), F.to_timestamp_ntz(text, fmt_col)
    )


def _by_position(date_text: Column, time_text: Column, hour_at: int) -> Column:
    """The time whose digits stand at their places in two texts of the usual shapes; null where
    there is no such time."""

    def digits(text: Column, first: int, count: int = 2) -> Column:
        return F.substring(text, first, count).cast("int")

    second = digits(time_text, hour_at + 6)
    made = F.try_make_timestamp_ntz(
        digits(date_text, 7, 4),
        digits(date_text, 1),
        digits(date_text, 4),
        digits(time_text, hour_at),
        digits(time_text, hour_at + 3),
        second,
    )
    return F.when(second < 60, made)  # a second of 60 is refused, not carried over


def compose_datetime(date_text: Column, time_text: Column) -> Column:
    """``date + " " + time`` parsed as ``MM-dd-yyyy HH:mm:ss``.

    A missing date or time gives a null datetime. Two texts of the usual shapes are taken apart
    where they are; only others are joined (``concat``, not ``concat_ws``, so that a null stays
    one) and go through the formatter.
    """
    usual = date_text.rlike(rf"^{_DATE_SHAPE}\z") & time_text.rlike(rf"^{_TIME_SHAPE}\z")
    whole = F.concat(date_text, F.lit(" "), time_text)
    return F.when(usual, _by_position(date_text, time_text, 1)).otherwise(
        _formatted(whole, DATETIME_FORMAT)
    )


def truncate_to_second(ts: Column) -> Column:
    """Drop the fractional seconds of a ``TIMESTAMP_NTZ`` without touching any time zone."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)
    )


def service_date(ts: Column) -> Column:
    """Calendar day of a ``TIMESTAMP_NTZ`` (the Parquet day partition key)."""
    return ts.cast("date")


# Fixed parameters of the position key: coordinates are clamped to the globe and
# quantized to 20 bits each (about 0.0002 degrees, some 20 m), interleaved into 40 bits.
POSITION_BITS = 20
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)


def _quantize(c: Column, lo: float, hi: float, bits: int) -> Column:
    scale = float((1 << bits) - 1)
    clamped = F.least(F.greatest(c, F.lit(lo)), F.lit(hi))  # NaN sorts as the largest
    return F.floor((clamped - F.lit(lo)) / F.lit(hi - lo) * F.lit(scale))


def _spread_bits(v: Column) -> Column:
    """Move bit ``i`` of a value below 2^32 to bit ``2i`` (zeros in between)."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def position_key(latitude: Column, longitude: Column, bits: int = POSITION_BITS) -> Column:
    """Z-order (Morton) key of a position: the bits of quantized latitude and longitude
    interleaved. Sorting by it keeps nearby positions together in both directions, so the
    min/max statistics of each Parquet page bound a small box. Null if a coordinate is
    null. Built-in bit operations only (whole-stage codegen)."""
    lat = _spread_bits(_quantize(latitude, *LATITUDE_RANGE, bits))
    lon = _spread_bits(_quantize(longitude, *LONGITUDE_RANGE, bits))
    # greatest/least skip nulls, so a missing coordinate is handled here, not by clamping.
    return F.when(
        latitude.isNotNull() & longitude.isNotNull(), lat.bitwiseOR(F.shiftleft(lon, 1))
    )
