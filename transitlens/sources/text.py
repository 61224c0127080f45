"""Daily delimited text files of vehicle pings.

One headerless, comma-separated file (or folder of part files) per day, seven positional
fields: ``date,time,bus_id,bus_line,latitude,longitude,speed``. Reading uses Spark's CSV
source with a declared schema: no inference pass, no Python worker, and the speed and box
comparisons are pushed into the CSV parser so rejected rows are never fully converted.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from transitlens.functions.columns import compose_datetime
from transitlens.functions.predicates import TimeWindow, outlier_condition
from transitlens.schema import (
    DATE_FORMAT,
    MAX_PLAUSIBLE_SPEED,
    RAW_FIELDS,
    RAW_SCHEMA,
    TIME_FORMAT,
)

DAY_FOLDER = "day"  # name of the folders of write_day_files

# Besides decimal numbers, these spellings are numbers in a speed or a position.
# ``Infinity`` and ``NaN`` may carry a sign and blanks around them; the short forms stand as they
# are. Any other word is no number (null). Both readers follow this one rule.
POSITIVE_INFINITY, NEGATIVE_INFINITY = "inf", "-inf"
NUMBER_WORDS = r"^[\x00-\x20]*[+-]?(Infinity|NaN)[\x00-\x20]*$"

# Plain ``str.split(",")`` semantics: no quoting, no escaping, no comments.
CSV_OPTIONS = {
    "sep": ",",
    "header": "false",
    "quote": "",
    "escape": "",
    "mode": "PERMISSIVE",
    "multiLine": "false",
    "encoding": "UTF-8",
    "positiveInf": POSITIVE_INFINITY,
    "negativeInf": NEGATIVE_INFINITY,
}


def day_paths(template: str, first: date, last: date) -> list[str]:
    """One path per calendar day from ``first`` to ``last`` inclusive.

    ``template`` is a ``strftime`` pattern, e.g. ``"hdfs://nn/pings/%Y-%m-%d.txt"`` for flat
    day files or ``"/data/pings/day=%Y-%m-%d"`` for the folders :func:`write_day_files`
    produces. Days are zero-padded by the pattern.
    """
    if last < first:
        return []
    return [(first + timedelta(days=i)).strftime(template) for i in range((last - first).days + 1)]


def window_paths(template: str, window: TimeWindow) -> list[str]:
    """The day files that can hold a row of ``window``, for :func:`day_paths` templates.

    Use it where file names are the days of their rows, as in the original program: only
    these files are read (``load_pings(spark, window_paths(...))``, then the window itself).
    """
    days = window.day_range()
    return day_paths(template, *days) if days else []


def read_raw(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Typed raw rows of one or more day files, read in a single scan (a bag union: files
    are concatenated, duplicates kept).

    Unreadable numbers, short rows and empty fields become null; blank lines are skipped;
    fields past the seventh are ignored.
    """
    if isinstance(paths, str):
        paths = [paths]
    if not paths:
        raise ValueError("no input paths")
    return spark.read.options(**CSV_OPTIONS).schema(RAW_SCHEMA).csv(list(paths))


def number(text: Column) -> Column:
    """A text field as a double by the rule of the CSV source (see ``NUMBER_WORDS``); anything
    that is no number gives null. A cast alone would read more spellings of infinity than the
    source does (``-INF``, `` infinity``); every one of them has an ``n``."""
    word = text.isin(POSITIVE_INFINITY, NEGATIVE_INFINITY) | text.rlike(NUMBER_WORDS)
    return F.when(~text.rlike("[nN]") | word, text.try_cast("double"))


def split_lines(lines: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Raw rows from a one-string-column frame of text lines (``spark.read.text``).

    The same result as :func:`read_raw` for well-formed lines. With ``strict=True`` a line
    with fewer than seven fields fails the job instead of producing nulls.
    """
    parts = F.split(F.col(column), ",", -1)
    fields: list[Column] = []
    for i, name in enumerate(RAW_FIELDS):
        field = F.get(parts, i)
        if RAW_SCHEMA[name].dataType.typeName() == "double":
            field = number(field)
        if strict and name == "speed":
            # The check rides on ``speed``: every query reads it (the outlier filter), so
            # column pruning can never drop the check.
            field = F.when(
                F.size(parts) < len(RAW_FIELDS),
                F.raise_error(
                    F.concat(F.lit("ping line has fewer than 7 fields: "), F.col(column))
                ).cast("double"),
            ).otherwise(field)
        fields.append(field.alias(name))
    if strict:
        return lines.select(*fields)
    return lines.where(F.col(column) != F.lit("")).select(*fields)


def clean(raw: DataFrame, max_speed: float = MAX_PLAUSIBLE_SPEED) -> DataFrame:
    """Raw rows to the ping table: compose ``datetime``, drop outliers, fix column order.

    Empty id and line fields are read as null by the CSV source; they are restored to
    empty strings, which is what a plain string split yields.
    """
    return raw.where(outlier_condition(max_speed)).select(
        F.coalesce(F.col("bus_id"), F.lit("")).alias("bus_id"),
        F.coalesce(F.col("bus_line"), F.lit("")).alias("bus_line"),
        "latitude",
        "longitude",
        "speed",
        compose_datetime(F.col("date"), F.col("time")).alias("datetime"),
    )


def parse_lines(
    lines: DataFrame,
    column: str = "value",
    strict: bool = False,
    max_speed: float = MAX_PLAUSIBLE_SPEED,
) -> DataFrame:
    """Text lines (one string column) to the clean ping table."""
    return clean(split_lines(lines, column, strict), max_speed)


def load_pings(
    spark: SparkSession,
    paths: str | Sequence[str],
    strict: bool = False,
    max_speed: float = MAX_PLAUSIBLE_SPEED,
) -> DataFrame:
    """Read day files into the clean ping table (lazy).

    ``strict=True`` reads the files as lines and fails on a row with fewer than seven
    fields, like the original per-line split did; the default keeps going and drops such
    rows (their speed is null).
    """
    if strict:
        if isinstance(paths, str):
            paths = [paths]
        return parse_lines(spark.read.text(list(paths)), strict=True, max_speed=max_speed)
    return clean(read_raw(spark, paths), max_speed)


def load_day_folders(
    spark: SparkSession, base: str, window: TimeWindow | None = None, max_speed: float = MAX_PLAUSIBLE_SPEED
) -> DataFrame:
    """Pings of the day folders ``base/day=YYYY-MM-DD/`` (as :func:`write_day_files` makes them),
    all of them or those inside ``window``.

    The folders are partitions: a window reads only the folders of days that it can touch, however
    many there are. That trusts a folder's name to be the day of its rows, which holds for folders
    written by this library; for others use :func:`load_pings` and a restriction.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(DAY_FOLDER, T.DateType(), True)])
    raw = spark.read.options(**CSV_OPTIONS).option("basePath", base).schema(schema).csv(base)
    if window is not None:
        raw = raw.where(window.partition_condition(DAY_FOLDER))
    pings = clean(raw, max_speed)
    return pings if window is None else pings.where(window.condition())


def line_expr() -> Column:
    """The raw text line of a ping-table row.

    Null fields become empty fields: null numbers and times read back as null, null ids as
    empty text. Doubles use Spark's round-tripping text, so the values read back are
    bit-identical. Times are written to the second; a fraction is dropped. An id or line with
    a comma or a line break cannot be told from two fields or lines and fails the job.
    """

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def plain(name: str) -> Column:
        c = F.col(name)
        wrong = F.raise_error(F.concat(F.lit(f"{name} holds a comma or a line break: "), c)).cast("string")
        return F.when(c.rlike("[,\\r\\n]"), wrong).otherwise(text(c))

    ts = F.col("datetime")
    return F.concat_ws(
        ",",
        F.coalesce(F.date_format(ts, DATE_FORMAT), F.lit("")),
        F.coalesce(F.date_format(ts, TIME_FORMAT), F.lit("")),
        plain("bus_id"),
        plain("bus_line"),
        text(F.col("latitude")),
        text(F.col("longitude")),
        text(F.col("speed")),
    ).alias("value")


def to_lines(pings: DataFrame) -> DataFrame:
    """Render a ping table back to raw text lines (one ``value`` column)."""
    return pings.select(line_expr())


def write_day_files(pings: DataFrame, base: str, mode: str = "errorifexists") -> str:
    """Write pings as raw day files under ``base/day=YYYY-MM-DD/`` (one folder per day).

    Read them back with ``load_pings(spark, day_paths(base + "/day=%Y-%m-%d", d1, d2))``.
    Each task writes one file per day it holds; no shuffle. Rows without a datetime go to
    ``day=__HIVE_DEFAULT_PARTITION__``.
    """
    pings.select(
        line_expr(), F.date_format(F.col("datetime"), "yyyy-MM-dd").alias(DAY_FOLDER)
    ).write.mode(mode).partitionBy(DAY_FOLDER).text(base)
    return base
