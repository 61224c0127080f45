"""Data extent and construction of the time windows the reports use."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, functions as F

from transitlens.functions.columns import date_literal
from transitlens.functions.predicates import TimeWindow, day_is_known, growing_groups, in_days, layout_days
from transitlens.schema import DEFAULT_MONTH, DEFAULT_YEAR, SERVICE_DATE

CLOCK_FORMAT = "%H:%M:%S"


def time_extent(pings: DataFrame) -> DataFrame:
    """One row: ``first_datetime`` and ``last_datetime`` (min and max of ``datetime``).

    The original program took the first and last row in file order; for time-sorted day
    files that is the same, and for unsorted files min/max is the order-independent
    answer (the file-order one is ``clock_window(..., extent="file_order")``). Null on
    empty input. A global aggregate: each task sends one partial row.

    On the day-partitioned layout the first and last days are found first from the folder
    names (:func:`extent_days`). The minimum and maximum then lie in those two day partitions,
    so only those two days are read, not the whole archive.
    """
    ts = F.col("datetime")
    if day_is_known(pings):
        first, last = extent_days(pings)
        day = F.col(SERVICE_DATE)
        if first is None:
            pings = pings.where(F.lit(False))
        else:
            pings = pings.where((day == date_literal(first)) | (day == date_literal(last)))
    return pings.agg(F.min(ts).alias("first_datetime"), F.max(ts).alias("last_datetime"))


def parse_clock(text: str | time) -> time:
    """``HH:MM:SS`` text to a ``time``; anything else is a ``ValueError``."""
    if isinstance(text, time):
        return text
    return datetime.strptime(text, CLOCK_FORMAT).time()


def _day(year: int, month: int, day: int | str) -> date:
    return date(int(year), int(month), int(day))


def clock_window(
    pings: DataFrame,
    clock_start: str | time,
    clock_end: str | time,
    extent: str = "range",
) -> TimeWindow:
    """From the first day of the data at ``clock_start`` to its last day at ``clock_end``.

    One interval across the whole extent, not a repeated daily band. Runs one small job
    and returns literal bounds, so the query that uses the window still gets its bounds
    pushed down to the scan. Empty input gives an empty window.

    ``extent="range"`` (default) takes the days of the smallest and largest ``datetime``
    (:func:`extent_days`). ``extent="file_order"`` takes the first and the last row in
    input order, as the original program did: paths in the order they were given, the files
    of one folder in name order, rows in file order. It needs a frame over one text scan;
    any other frame has no input order and is a ``ValueError``.
    """
    start_clock, end_clock = parse_clock(clock_start), parse_clock(clock_end)
    if extent == "range":
        first_day, last_day = extent_days(pings)
    elif extent == "file_order":
        first_day, last_day = _file_order_days(pings)
    else:
        raise ValueError(f"extent must be 'range' or 'file_order', got {extent!r}")
    if first_day is None or last_day is None:
        return TimeWindow.empty()
    return TimeWindow(
        datetime.combine(first_day, start_clock), datetime.combine(last_day, end_clock)
    )


def _text_location(pings: DataFrame):
    """File index of the one text scan that ``pings`` is made from."""
    leaves = pings._jdf.queryExecution().analyzed().collectLeaves()
    leaf = leaves.head() if leaves.size() == 1 else None
    if leaf is not None and leaf.getClass().getSimpleName().startswith("LogicalRelation"):
        relation = leaf.relation()
        if relation.getClass().getSimpleName() == "HadoopFsRelation" and relation.fileFormat().getClass().getSimpleName() in (
            "CSVFileFormat",
            "TextFileFormat",
        ):
            return relation.location()
    raise ValueError("extent='file_order' needs pings read from text day files in one scan")


def file_ends(pings: DataFrame, columns: list) -> tuple[DataFrame, list[Column]]:
    """(``datetime``, ``file``, ``pos`` and ``columns`` of every row; aggregates that give a group's
    first and last row as ``first`` and ``last``), for frames over one text scan.

    ``head()``/``tail()`` would follow Spark's split order, which packs the largest files
    first, so first and last rows come from ``min_by``/``max_by`` over a per-row position,
    partially aggregated in every task. The position grows with the row's offset inside a
    file, since one file's splits keep their offset order.
    """
    _text_location(pings)
    rows = pings.select(
        "datetime",
        F.regexp_replace(F.input_file_name(), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "").alias("file"),
        F.monotonically_increasing_id().alias("pos"),
        *columns,
    )  # evaluated at the scan
    row = F.struct("datetime")  # never null itself, so a row without a time counts as a row
    return rows, [
        F.min_by(row, "pos").alias("first"),
        F.max_by(row, "pos").alias("last"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    ]


def listed_order_days(pings: DataFrame, ends: DataFrame) -> tuple[date | None, date | None]:
    """Dates of the first and last row in input order: listed paths in their order, files of
    a listed folder by name, rows by their place in the file. ``ends`` has the columns of
    :func:`file_ends` by file and any other key."""
    location = _text_location(pings)
    roots = location.rootPaths()
    listed = F.array(*[F.lit(roots.apply(i).toUri().getRawPath()) for i in range(roots.size())])
    # a cached frame no longer knows its files; with a single file that does not matter
    unknown = F.lit(1 if len(location.inputFiles()) == 1 else 0)
    file = F.col("file")
    under = F.transform(listed, lambda root: (file == root) | file.startswith(F.concat(root, F.lit("/"))))
    place = F.when(file == "", unknown).otherwise(F.array_position(under, F.lit(True)).cast("int"))
    key = lambda pos: F.struct(place.alias("place"), "file", pos)
    row = ends.agg(
        F.min_by("first", key("first_pos")), F.max_by("last", key("last_pos")), F.min(place)
    ).first()
    if row[2] is None:
        return None, None
    if row[2] == 0:
        raise ValueError("extent='file_order' cannot tell the files of these pings; give them uncached")
    first, last = row[0]["datetime"], row[1]["datetime"]
    if first is None or last is None:
        raise ValueError("the first or last row in input order has no datetime")
    return first.date(), last.date()


def _file_order_days(pings: DataFrame) -> tuple[date | None, date | None]:
    """:func:`listed_order_days` from one pass over the rows."""
    rows, ends = file_ends(pings, [])
    return listed_order_days(pings, rows.groupBy("file").agg(*ends))


def extent_days(pings: DataFrame) -> tuple[date | None, date | None]:
    """First and last calendar day of the data.

    On the day-partitioned layout the candidates are the days that have a folder, taken from the
    file listing without a job. The first and the last of them that hold a row are looked for from
    either end, in growing groups of days: usually one row of one file a side, however many days
    the archive has. Elsewhere it is one single-row aggregate over the data.
    """
    if day_is_known(pings):
        days = [d for d in layout_days(pings) if d is not None]
        first = _first_with_rows(pings, days, F.min)
        return (first, _first_with_rows(pings, days[::-1], F.max)) if first is not None else (None, None)
    row = time_extent(pings).first()
    if row is None or row[0] is None or row[1] is None:
        return None, None
    return row[0].date(), row[1].date()


def _first_with_rows(pings: DataFrame, days: list[date], end: Callable[[Column], Column]) -> date | None:
    """The first of ``days`` (ascending with ``end`` min, descending with max) that holds a row."""
    for group in growing_groups(days):
        rows = pings.where(in_days(group))
        if len(group) == 1:
            found = None if rows.isEmpty() else group[0]
        else:
            found = rows.agg(end(F.col(SERVICE_DATE))).first()[0]
        if found is not None:
            return found
    return None


def day_window(
    day1: int | str, day2: int | str, year: int = DEFAULT_YEAR, month: int = DEFAULT_MONTH
) -> TimeWindow:
    """Midnight of ``day1`` to midnight of ``day2`` in ``year``-``month`` (open interval:
    midnight of day 1 and all of day 2 are outside; equal days select nothing)."""
    return TimeWindow(
        datetime.combine(_day(year, month, day1), time(0, 0)),
        datetime.combine(_day(year, month, day2), time(0, 0)),
    )


def day_clock_window(
    day1: int | str,
    day2: int | str,
    clock1: str | time,
    clock2: str | time,
    year: int = DEFAULT_YEAR,
    month: int = DEFAULT_MONTH,
) -> TimeWindow:
    """``day1`` at ``clock1`` to ``day2`` at ``clock2`` in ``year``-``month``."""
    return TimeWindow(
        datetime.combine(_day(year, month, day1), parse_clock(clock1)),
        datetime.combine(_day(year, month, day2), parse_clock(clock2)),
    )
