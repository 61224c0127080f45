"""Composed reports: speed statistics, mean speed per line and observation lists for one
restriction (box, window or both), as separate lazy DataFrames or one long DataFrame.

Every section reads only ``bus_line, datetime, speed`` of the restricted rows. The long
form is planned as two scans instead of one per section: one aggregate pass computes the
overall statistics and the per-line means together (each row is fed to its line group
and to the total group, then partially aggregated before the shuffle), and one
filter-and-tag pass emits each observation under every section it belongs to. With
``persist=True`` the restricted three-column rows are cached once and every section
reads the cache (one scan in total); call :meth:`Report.unpersist` (or use the report as
a context manager) when done.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from datetime import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from transitlens.functions.predicates import Box, TimeWindow, day_is_known, growing_groups, in_days, layout_days
from transitlens.operators.aggregates import STAT_COLUMNS, line_means_of, stat_columns, stats_of
from transitlens.operators.extent import clock_window, day_clock_window, day_window, parse_clock
from transitlens.operators.filters import restrict
from transitlens.functions.columns import date_literal
from transitlens.plans.clock import ClockPartials
from transitlens.schema import DEFAULT_MONTH, DEFAULT_YEAR, OBSERVATION_COLUMNS, SERVICE_DATE

LONG_SCHEMA = T.StructType(
    [
        T.StructField("section", T.StringType(), False),
        T.StructField("bus_line", T.StringType(), True),
        T.StructField("datetime", T.TimestampNTZType(), True),
        T.StructField("speed", T.DoubleType(), True),
        T.StructField("mean_speed", T.DoubleType(), True),
        T.StructField("variance_speed", T.DoubleType(), True),
        T.StructField("stddev_speed", T.DoubleType(), True),
        T.StructField("min_speed", T.DoubleType(), True),
        T.StructField("max_speed", T.DoubleType(), True),
    ]
)
LONG_COLUMNS = tuple(f.name for f in LONG_SCHEMA.fields)

STATS, LINE_MEANS, SLOW, EXACT, FAST = "stats", "line_means", "slow", "exact", "fast"


@dataclass(frozen=True)
class ReportSpec:
    """Which sections a report has and their speed thresholds (``None`` leaves one out)."""

    stats: bool = True
    line_means: bool = True
    slow_below: float | None = None
    exact: float | None = None
    fast_above: float | None = None

    def __post_init__(self) -> None:
        if not (self.stats or self.line_means) and all(
            v is None for v in (self.slow_below, self.exact, self.fast_above)
        ):
            raise ValueError("a report needs at least one section")

    def observation_conditions(self) -> list[tuple[str, Column]]:
        speed = F.col("speed")
        out: list[tuple[str, Column]] = []
        if self.slow_below is not None:
            out.append((SLOW, speed < F.lit(float(self.slow_below))))
        if self.exact is not None:
            out.append((EXACT, speed == F.lit(float(self.exact))))
        if self.fast_above is not None:
            out.append((FAST, speed > F.lit(float(self.fast_above))))
        return out

    def section_names(self) -> list[str]:
        names = [STATS] if self.stats else []
        if self.line_means:
            names.append(LINE_MEANS)
        return names + [name for name, _ in self.observation_conditions()]


class Report(Mapping):
    """Sections of one report by name (``stats``, ``line_means``, ``slow``, ``exact``,
    ``fast``), each a lazy DataFrame."""

    def __init__(
        self, base: DataFrame, spec: ReportSpec, persisted: bool, partials: ClockPartials | None = None
    ) -> None:
        """``partials`` has the aggregates of ``base`` where they are known already."""
        self._base = base
        self.spec = spec
        self.persisted = persisted
        self._partials = partials
        self._names = spec.section_names()
        self._built: dict[str, DataFrame] = {}

    def _build(self, name: str) -> DataFrame:
        base = self._base
        if name == STATS:
            return self._partials.stats() if self._partials else stats_of(base)
        if name == LINE_MEANS:
            return self._partials.line_means() if self._partials else line_means_of(base)
        cond = dict(self.spec.observation_conditions())[name]
        return base.where(cond).select(*OBSERVATION_COLUMNS)

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._names:
            raise KeyError(key)
        if key not in self._built:
            self._built[key] = self._build(key)
        return self._built[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def long(self) -> DataFrame:
        """All sections stacked: ``section`` plus the union of the section columns (see
        :data:`LONG_SCHEMA`), missing values as typed nulls."""
        if self._partials:
            known = [n for n in (LINE_MEANS, STATS) if n in self._names]
            parts = [self[n].withColumn("section", F.lit(n)) for n in known]
        else:
            parts = [aggregate_rows(self._base, self.spec)]
        parts = [p for p in (*parts, observation_rows(self._base, self.spec)) if p is not None]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LONG_SCHEMA])

    def show(self, n: int = 20, truncate: bool = False) -> None:
        """Print every section as a titled preview of ``n`` rows in a fixed order (the
        console output of the original program, made deterministic)."""
        for name in self:
            order = {STATS: None, LINE_MEANS: ["bus_line"]}.get(
                name, ["datetime", "bus_line", "speed"]
            )
            print(f"== {name}")
            preview(self[name], n, order).show(n, truncate=truncate)

    def unpersist(self) -> None:
        if self.persisted:
            self._base.unpersist()
            self.persisted = False

    def __enter__(self) -> "Report":
        return self

    def __exit__(self, *exc: object) -> None:
        self.unpersist()


def aggregate_rows(restricted: DataFrame, spec: ReportSpec) -> DataFrame | None:
    """The ``stats`` and ``line_means`` sections of the long form in one aggregation.

    Each row is fed to its line group (level 0) and to the total group (level 1), and both
    are aggregated together: one scan, one shuffle of partial buffers.
    """
    if not (spec.stats or spec.line_means):
        return None
    levels = []
    if spec.line_means:
        levels.append(F.struct(F.lit(0).alias("level"), F.col("bus_line").alias("bus_line")))
    if spec.stats:
        levels.append(
            F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("bus_line"))
        )
    fed = restricted.select(F.inline(F.array(*levels)), "speed")
    if spec.stats:
        # One row with a null speed guarantees the total group exists (all-null statistics
        # on empty input, as a global aggregate gives) and changes nothing otherwise: every
        # aggregate skips nulls. One partition: the default split count grows with the
        # cluster and would add that many empty tasks.
        sentinel = restricted.sparkSession.range(0, 1, 1, numPartitions=1).select(
            F.lit(1).alias("level"),
            F.lit(None).cast("string").alias("bus_line"),
            F.lit(None).cast("double").alias("speed"),
        )
        fed = fed.unionByName(sentinel)
    agg = fed.groupBy("level", "bus_line").agg(*stat_columns())
    is_total = F.col("level") == F.lit(1)
    return agg.select(
        F.when(is_total, F.lit(STATS)).otherwise(F.lit(LINE_MEANS)).alias("section"),
        "bus_line",
        "mean_speed",
        *[F.when(is_total, F.col(c)).alias(c) for c in STAT_COLUMNS if c != "mean_speed"],
    )


def observation_rows(restricted: DataFrame, spec: ReportSpec) -> DataFrame | None:
    """The observation sections (``slow``, ``exact``, ``fast``) as one filter-and-tag pass:
    ``section, bus_line, datetime, speed``, a row once per section it belongs to.

    Stateless (no shuffle), so it also runs unchanged on a stream.
    """
    conds = spec.observation_conditions()
    if not conds:
        return None
    any_cond = conds[0][1]
    for _, cond in conds[1:]:
        any_cond = any_cond | cond
    # A plain array of CASE WHEN tags keeps the explode inside whole-stage codegen (a
    # lambda filter on the array would not); unmatched tags are dropped afterwards.
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in conds])
    return (
        restricted.where(any_cond)
        .select(F.explode(tags).alias("section"), *OBSERVATION_COLUMNS)
        .where(F.col("section").isNotNull())
    )


def report(
    pings: DataFrame,
    box: Box | None = None,
    window: TimeWindow | None = None,
    spec: ReportSpec = ReportSpec(),
    persist: bool = False,
    storage_level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
) -> Report:
    """The sections of ``spec`` over the rows inside ``box`` and/or ``window``."""
    base = restrict(pings, box, window).select(*OBSERVATION_COLUMNS)
    if persist:
        base = base.persist(storage_level)
    return Report(base, spec, persist)


def report_long(rep: Report) -> DataFrame:
    """All sections of ``rep`` in one DataFrame (see :meth:`Report.long`)."""
    return rep.long()


# The sections and thresholds of the five reports of the original program.
BOX_SPEC = ReportSpec(slow_below=10.0, fast_above=50.0)
WINDOW_SPEC = ReportSpec(exact=0.0, fast_above=100.0)


def box_report(pings: DataFrame, box: Box, persist: bool = False) -> Report:
    """R1: statistics, line means, slower than 10, faster than 50, inside ``box``."""
    return report(pings, box=box, spec=BOX_SPEC, persist=persist)


def clock_report(
    pings: DataFrame,
    clock_start: str | time,
    clock_end: str | time,
    persist: bool = False,
    extent: str = "range",
) -> Report:
    """R2: first day of the data at ``clock_start`` to its last day at ``clock_end``;
    statistics, line means, stopped (speed 0), faster than 100. ``extent`` as in
    :func:`~transitlens.operators.extent.clock_window`.

    On the day-partitioned layout the extent costs no pass. Elsewhere (text, say) it comes with
    the statistics and line means from one pass (:class:`~transitlens.plans.clock.ClockPartials`),
    and the observation sections read the rows once more: two passes for the long form."""
    if persist or day_is_known(pings):
        window = clock_window(pings, clock_start, clock_end, extent=extent)
        return report(pings, window=window, spec=WINDOW_SPEC, persist=persist)
    partials = ClockPartials(pings, parse_clock(clock_start), parse_clock(clock_end), extent)
    base = restrict(pings, window=partials.window).select(*OBSERVATION_COLUMNS)
    return Report(base, WINDOW_SPEC, False, partials)


def days_report(
    pings: DataFrame,
    day1: int | str,
    day2: int | str,
    year: int = DEFAULT_YEAR,
    month: int = DEFAULT_MONTH,
    persist: bool = False,
) -> Report:
    """R3: midnight of ``day1`` to midnight of ``day2``; sections as :func:`clock_report`."""
    return report(
        pings, window=day_window(day1, day2, year, month), spec=WINDOW_SPEC, persist=persist
    )


def day_clock_report(
    pings: DataFrame,
    day1: int | str,
    day2: int | str,
    clock1: str | time,
    clock2: str | time,
    year: int = DEFAULT_YEAR,
    month: int = DEFAULT_MONTH,
    persist: bool = False,
) -> Report:
    """R4: ``day1`` at ``clock1`` to ``day2`` at ``clock2``; sections as :func:`clock_report`."""
    window = day_clock_window(day1, day2, clock1, clock2, year, month)
    return report(pings, window=window, spec=WINDOW_SPEC, persist=persist)


def full_report(
    pings: DataFrame,
    box: Box,
    day1: int | str,
    day2: int | str,
    clock1: str | time,
    clock2: str | time,
    year: int = DEFAULT_YEAR,
    month: int = DEFAULT_MONTH,
    persist: bool = False,
) -> Report:
    """R5: inside ``box`` and from ``day1`` at ``clock1`` to ``day2`` at ``clock2``;
    sections as :func:`clock_report` (the "faster than" threshold is 100, as its title says)."""
    window = day_clock_window(day1, day2, clock1, clock2, year, month)
    return report(pings, box=box, window=window, spec=WINDOW_SPEC, persist=persist)


def preview(df: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in a fixed order (all columns by default): a deterministic
    stand-in for ``show()``. Planned as a per-task top-``n`` and a final merge of
    ``n * tasks`` rows, never a full sort.

    On the day-partitioned layout, when the order starts with ``datetime``, only the
    earliest days that together hold ``n`` rows are read. Rows without a time sort first,
    and a later day's rows all come after an earlier day's. The days come from the folder
    names; rows are counted from the earliest day on, in growing groups of days, until ``n``
    are found, so the files opened grow with ``n`` and not with the archive.
    """
    order = list(order or df.columns)
    if n > 0 and order[0] == "datetime" and day_is_known(df):
        df = df.where(_earliest_days(df, n))
    return df.orderBy(*order).limit(n)


def _earliest_days(df: DataFrame, n: int) -> Column:
    """Condition selecting the day partitions that can hold the first ``n`` rows by time."""
    day = F.col(SERVICE_DATE)
    days = layout_days(df)
    total = df.where(day.isNull()).limit(n).count() if None in days else 0
    last = None
    for group in growing_groups([d for d in days if d is not None]):
        if total >= n:
            break
        counts = {r[0]: r[1] for r in df.where(in_days(group)).groupBy(day).count().collect()}  # a row a day
        for d in group:
            if total < n:
                total, last = total + counts.get(d, 0), d
    return day.isNull() if last is None else day.isNull() | (day <= date_literal(last))
