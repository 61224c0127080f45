"""Speed aggregates over a restricted ping table.

Both are hash aggregates with map-side partial aggregation: every task reduces its rows to
one buffer per line (or one in total) before the shuffle, so a line holding a third of all
rows costs the shuffle one buffer per task, not a third of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transitlens.functions.predicates import Box, TimeWindow
from transitlens.operators.filters import restrict

STAT_COLUMNS = ("mean_speed", "variance_speed", "stddev_speed", "min_speed", "max_speed")


def stat_columns(speed: str = "speed") -> list[Column]:
    """Mean, sample variance, sample standard deviation, minimum and maximum of ``speed``.

    One row gives null variance and deviation; no rows gives nulls everywhere.
    """
    s = F.col(speed)
    return [
        F.avg(s).alias("mean_speed"),
        F.var_samp(s).alias("variance_speed"),
        F.stddev_samp(s).alias("stddev_speed"),
        F.min(s).alias("min_speed"),
        F.max(s).alias("max_speed"),
    ]


def line_means_of(rows: DataFrame) -> DataFrame:
    """``bus_line, mean_speed`` over all of ``rows``."""
    return rows.groupBy("bus_line").agg(F.avg("speed").alias("mean_speed"))


def stats_of(rows: DataFrame) -> DataFrame:
    """One row of :func:`stat_columns` over all of ``rows``."""
    return rows.agg(*stat_columns())


def line_mean(
    pings: DataFrame, box: Box | None = None, window: TimeWindow | None = None
) -> DataFrame:
    """Mean speed per bus line inside the box and/or window: ``bus_line, mean_speed``.

    Unordered; lines without a row inside are absent.
    """
    return line_means_of(restrict(pings, box, window))


def speed_stats(
    pings: DataFrame, box: Box | None = None, window: TimeWindow | None = None
) -> DataFrame:
    """One row of speed statistics inside the box and/or window (see :func:`stat_columns`)."""
    return stats_of(restrict(pings, box, window))
