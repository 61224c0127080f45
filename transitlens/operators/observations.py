"""Observation queries: the pings below, above or at a speed, as ``bus_line, datetime,
speed``. Filter and projection only, pushed to the scan; duplicates are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transitlens.functions.predicates import Box, TimeWindow, restriction
from transitlens.schema import OBSERVATION_COLUMNS


def _observe(
    pings: DataFrame, speed_cond: Column, box: Box | None, window: TimeWindow | None
) -> DataFrame:
    return pings.where(restriction(pings, box, window) & speed_cond).select(*OBSERVATION_COLUMNS)


def slower_than(
    pings: DataFrame, speed: float, box: Box | None = None, window: TimeWindow | None = None
) -> DataFrame:
    """Pings slower than ``speed`` (strictly) inside the box and/or window."""
    return _observe(pings, F.col("speed") < F.lit(float(speed)), box, window)


def faster_than(
    pings: DataFrame, speed: float, box: Box | None = None, window: TimeWindow | None = None
) -> DataFrame:
    """Pings faster than ``speed`` (strictly) inside the box and/or window."""
    return _observe(pings, F.col("speed") > F.lit(float(speed)), box, window)


def at_speed(
    pings: DataFrame, speed: float, box: Box | None = None, window: TimeWindow | None = None
) -> DataFrame:
    """Pings at exactly ``speed`` (double equality; ``0`` finds stopped vehicles)."""
    return _observe(pings, F.col("speed") == F.lit(float(speed)), box, window)
