"""The clock report in one pass for its aggregates.

The clock window runs from the first day of the data at one clock time to its last day at
another, so it is known only after all rows were seen. Each row is therefore aggregated under its
day, its line and its side of the two clock times; when the days are known, the groups inside the
window are merged. A table of at most (days x lines x 3) rows replaces two of the three passes
over text: one to learn the extent, one to aggregate.
"""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, functions as F

from transitlens.functions.columns import date_literal
from transitlens.functions.predicates import TimeWindow
from transitlens.operators.extent import file_ends, listed_order_days
from transitlens.session import scratch_path


def _past(clock: time) -> Column:
    """A clock time as a distance from midnight."""
    seconds = F.lit(f"{clock.second}.{clock.microsecond:06d}").cast("decimal(18,6)")
    return F.make_dt_interval(F.lit(0), F.lit(clock.hour), F.lit(clock.minute), seconds)


class ClockPartials:
    """Speed aggregates of ``pings`` by day, line and side of two clock times, written to the
    scratch folder in one pass. ``extent`` as in
    :func:`~transitlens.operators.extent.clock_window`."""

    def __init__(self, pings: DataFrame, start: time, end: time, extent: str = "range") -> None:
        ts, speed = F.col("datetime"), F.col("speed")
        midnight = ts.cast("date").cast("timestamp_ntz")
        keys = {
            "day": ts.cast("date"),
            "bus_line": F.col("bus_line"),
            "after": ts > midnight + _past(start),
            "before": ts < midnight + _past(end),
        }
        ends: list[Column] = []
        rows = pings.select("datetime", "speed", *[c.alias(name) for name, c in keys.items()])
        if extent == "file_order":
            rows, ends = file_ends(pings, ["speed", *[c.alias(name) for name, c in keys.items()]])
            keys["file"] = F.col("file")
        elif extent != "range":
            raise ValueError(f"extent must be 'range' or 'file_order', got {extent!r}")
        parts = rows.groupBy(*keys).agg(
            F.count(speed).alias("n"),
            F.avg(speed).alias("mean"),
            (F.var_pop(speed) * F.count(speed)).alias("off"),  # summed squares about the mean
            F.min(speed).alias("least"),
            F.max(speed).alias("most"),
            *ends,
        )
        path = scratch_path(pings.sparkSession, "clock-partials")
        parts.write.parquet(path)
        self.parts = pings.sparkSession.read.schema(parts.schema).parquet(path)
        # one row: the days, and a mean to take squares about
        row = self.parts.agg(F.min("day"), F.max("day"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")).first()
        self.first: date | None = row[0]
        self.last: date | None = row[1]
        self._middle = row[2] if row[2] is not None else 0.0
        if extent == "file_order":
            self.first, self.last = listed_order_days(pings, self.parts)
        self.start, self.end = start, end

    @property
    def window(self) -> TimeWindow:
        if self.first is None or self.last is None:
            return TimeWindow.empty()
        return TimeWindow(datetime.combine(self.first, self.start), datetime.combine(self.last, self.end))

    def inside(self) -> DataFrame:
        """The groups that lie inside the window; every group is inside or outside as a whole."""
        if self.first is None or self.last is None:
            return self.parts.where(F.lit(False))
        day, first, last = F.col("day"), date_literal(self.first), date_literal(self.last)
        return self.parts.where(
            ((day > first) | ((day == first) & F.col("after"))) & ((day < last) | ((day == last) & F.col("before")))
        )

    def line_means(self) -> DataFrame:
        """``bus_line, mean_speed``, as :func:`~transitlens.operators.aggregates.line_means_of`."""
        mean = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
        return self.inside().groupBy("bus_line").agg(mean.alias("mean_speed"))

    def stats(self) -> DataFrame:
        """One row, as :func:`~transitlens.operators.aggregates.stats_of`."""
        n, mean = F.col("n"), F.col("mean")
        middle = F.lit(float(self._middle))
        merged = self.inside().agg(
            F.sum("n").alias("n"),
            F.sum(n * mean).alias("total"),
            F.sum(n * (mean - middle)).alias("shift"),
            F.sum(F.col("off") + n * (mean - middle) * (mean - middle)).alias("off"),
            F.min("least").alias("min_speed"),
            F.max("most").alias("max_speed"),
        )
        # squares about the middle, moved to the mean; rounding may leave less than none
        off = F.greatest(F.col("off") - F.try_divide(F.col("shift") * F.col("shift"), n), F.lit(0.0))
        variance = F.when(n > 1, off / (n - 1))
        return merged.select(
            F.try_divide(F.col("total"), n).alias("mean_speed"),
            variance.alias("variance_speed"),
            F.sqrt(variance).alias("stddev_speed"),
            "min_speed",
            "max_speed",
        )
