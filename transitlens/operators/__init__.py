"""Operators on the ping table: filters, aggregates, observation lists, extent/windows."""

from transitlens.operators.aggregates import STAT_COLUMNS, line_mean, speed_stats, stat_columns
from transitlens.operators.extent import (
    clock_window,
    day_clock_window,
    day_window,
    parse_clock,
    time_extent,
)
from transitlens.operators.filters import drop_outliers, restrict
from transitlens.operators.observations import at_speed, faster_than, slower_than

__all__ = [
    "STAT_COLUMNS",
    "at_speed",
    "clock_window",
    "day_clock_window",
    "day_window",
    "drop_outliers",
    "faster_than",
    "line_mean",
    "parse_clock",
    "restrict",
    "slower_than",
    "speed_stats",
    "stat_columns",
    "time_extent",
]
