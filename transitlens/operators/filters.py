"""Row filters: outlier removal and box / window restriction. Narrow operators (no shuffle);
every comparison is against a literal, so Catalyst pushes it to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from transitlens.functions.predicates import Box, TimeWindow, outlier_condition, restriction
from transitlens.schema import MAX_PLAUSIBLE_SPEED


def drop_outliers(df: DataFrame, max_speed: float = MAX_PLAUSIBLE_SPEED) -> DataFrame:
    """Keep rows with ``speed <= max_speed``; null, NaN and larger speeds are dropped."""
    return df.where(outlier_condition(max_speed))


def restrict(df: DataFrame, box: Box | None = None, window: TimeWindow | None = None) -> DataFrame:
    """Rows strictly inside ``box``, strictly inside ``window``, or both.

    Giving neither is a ``ValueError``. On day-partitioned input the window also prunes
    whole day partitions.
    """
    return df.where(restriction(df, box, window))
