"""Query restrictions: a longitude/latitude box and an open time window.

Every bound is strict. A row whose coordinate or time is null fails the comparison and is
dropped by the restriction that uses it (a box drops null coordinates, a window drops null
times), as plain SQL comparisons do.
"""

from __future__ import annotations

import decimal
import math
import numbers
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from transitlens.functions.columns import date_literal, ntz_literal
from transitlens.schema import MAX_PLAUSIBLE_SPEED, SERVICE_DATE


@dataclass(frozen=True)
class Box:
    """Open longitude/latitude rectangle: ``west < longitude < east`` and
    ``south < latitude < north``.

    Swapped bounds are allowed and select nothing, as a plain comparison would.
    """

    east: float
    west: float
    north: float
    south: float

    def __post_init__(self) -> None:
        for name in ("east", "west", "north", "south"):
            value = getattr(self, name)
            if (
                value is None
                or isinstance(value, bool)
                or not isinstance(value, (numbers.Real, decimal.Decimal))
                or math.isnan(float(value))
            ):
                raise ValueError(f"Box.{name} must be a number, got {value!r}")
            object.__setattr__(self, name, float(value))

    @classmethod
    def from_args(cls, long1: float, long2: float, lat1: float, lat2: float) -> "Box":
        """Upper bound first, as on the original command line: east, west, north, south."""
        return cls(east=long1, west=long2, north=lat1, south=lat2)

    def condition(self, longitude: str = "longitude", latitude: str = "latitude") -> Column:
        lon, lat = F.col(longitude), F.col(latitude)
        return (
            (lon < F.lit(self.east))
            & (lon > F.lit(self.west))
            & (lat < F.lit(self.north))
            & (lat > F.lit(self.south))
        )


@dataclass(frozen=True)
class TimeWindow:
    """Open time interval ``start < datetime < end`` on wall-clock (``TIMESTAMP_NTZ``) time.

    ``TimeWindow.empty()`` selects nothing (used when the data has no extent).
    """

    start: datetime | None
    end: datetime | None

    def __post_init__(self) -> None:
        if (self.start is None) != (self.end is None):
            raise ValueError("TimeWindow needs both start and end, or neither (empty window)")
        for name in ("start", "end"):
            value = getattr(self, name)
            if value is not None and not isinstance(value, datetime):
                raise ValueError(f"TimeWindow.{name} must be a datetime, got {value!r}")
            if value is not None and value.tzinfo is not None:
                raise ValueError("TimeWindow bounds are wall-clock times; pass naive datetimes")

    @classmethod
    def empty(cls) -> "TimeWindow":
        return cls(None, None)

    @property
    def is_empty(self) -> bool:
        return self.start is None

    def condition(self, column: str = "datetime") -> Column:
        if self.is_empty:
            return F.lit(False)
        ts = F.col(column)
        return (ts > ntz_literal(self.start)) & (ts < ntz_literal(self.end))

    def day_range(self) -> tuple[date, date] | None:
        """Inclusive range of calendar days that can hold a row of the window."""
        if self.is_empty:
            return None
        first = self.start.date()
        last = self.end.date()
        if self.end.time() == time(0, 0):
            # The window is open at ``end``, so nothing of that midnight's day is inside.
            last = last - timedelta(days=1)
        return first, last

    def partition_condition(self, column: str = SERVICE_DATE) -> Column:
        """Redundant day-level bound for partition pruning of day-partitioned data.

        Catalyst does not derive a bound on the partition column from a bound on
        ``datetime``, so this is added next to :meth:`condition`.
        """
        days = self.day_range()
        if days is None:
            return F.lit(False)
        first, last = days
        day = F.col(column)
        return (day >= date_literal(first)) & (day <= date_literal(last))


def outlier_condition(max_speed: float = MAX_PLAUSIBLE_SPEED, column: str = "speed") -> Column:
    """``speed <= max_speed``. Null and NaN speeds fail it (Spark orders NaN above every number)."""
    return F.col(column) <= F.lit(float(max_speed))


def day_is_known(df: DataFrame) -> bool:
    """Whether the layout's day column provably is the day of ``datetime``: both come untouched
    from one scan of a layout that :func:`~transitlens.sources.parquet.write_partitioned` wrote.

    The analysed plan must have one leaf that puts out both columns under the ids they have in
    ``df``. A computed ``datetime`` (shifted to another zone, say), a joined or a united frame
    fails that, and is then answered from all rows without day pruning.
    """
    if SERVICE_DATE not in df.columns or "datetime" not in df.columns or not hasattr(df, "_jdf"):
        return False
    relation = _one_file_relation(df)
    if relation is None or SERVICE_DATE not in list(relation.relation().partitionSchema().fieldNames()):
        return False

    def ids(output) -> set[str]:
        """name#id of the two columns; one call for the whole list, since each costs a round trip."""
        return set(_DAY_COLUMNS.findall(output.mkString(",")))

    known = ids(relation.output())
    return len(known) == 2 and ids(df._jdf.queryExecution().analyzed().output()) == known


def _one_file_relation(df: DataFrame):
    """The one leaf of the analysed plan, if it is a scan of files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    leaf = leaves.head() if leaves.size() == 1 else None
    if leaf is None or not leaf.getClass().getSimpleName().startswith("LogicalRelation"):
        return None
    return leaf if leaf.relation().getClass().getSimpleName() == "HadoopFsRelation" else None


_DAY_COLUMNS = re.compile(rf"(?:^|,)((?:{SERVICE_DATE}|datetime)#[0-9]+)(?=,|$)")
_DAY_FOLDER = re.compile(rf"{SERVICE_DATE}=([^/\s,)]+)")


def layout_days(df: DataFrame) -> list[date | None]:
    """The days that the layout under ``df`` has a folder with files for, in order; None first,
    for rows without a time.

    They come from the file listing that the frame already holds: no job, no file is opened, and
    one line a day reaches Python. A folder's files may hold no row, and ``df`` may filter rows,
    so a listed day is only a candidate. Needs :func:`day_is_known`.
    """
    folders = _one_file_relation(df).relation().location().partitionSpec().partitions().mkString("\n")
    found = set(_DAY_FOLDER.findall(folders))
    days: list[date | None] = [None] if found - (dated := {x for x in found if x[:1].isdigit()}) else []
    return days + sorted(date.fromisoformat(x) for x in dated)


def growing_groups(days: list[date]) -> Iterator[list[date]]:
    """``days`` in groups of 1, 2, 4, ... in the given order: looking for rows from one end then
    takes few jobs, and reads about twice the days up to the first row at most."""
    lo, size = 0, 1
    while lo < len(days):
        yield days[lo : lo + size]
        lo, size = lo + size, 2 * size


def in_days(days: list[date], column: str = SERVICE_DATE) -> Column:
    """Rows of a group of consecutive listed days, as a range that prunes partitions."""
    day = F.col(column)
    return (day >= date_literal(min(days))) & (day <= date_literal(max(days)))


def restriction(
    df: DataFrame, box: Box | None = None, window: TimeWindow | None = None
) -> Column:
    """One conjunctive predicate for a box, a window or both.

    At least one of the two must be given (the only shapes the original program offers).
    Where ``df`` provably is the day-partitioned layout (:func:`day_is_known`) the window also
    contributes a partition filter.
    """
    if box is None and window is None:
        raise ValueError("give a Box, a TimeWindow, or both")
    parts: list[Column] = []
    if window is not None:
        if day_is_known(df):
            parts.append(window.partition_condition())
        parts.append(window.condition())
    if box is not None:
        parts.append(box.condition())
    cond = parts[0]
    for part in parts[1:]:
        cond = cond & part
    return cond
