"""Vehicle GPS ping analytics on Spark DataFrames.

Load day files (or day-partitioned Parquet) into a ping table, restrict it to a
longitude/latitude :class:`Box` and/or an open :class:`TimeWindow`, and compute speed
statistics, mean speed per line, slow / stopped / fast observations, or whole reports.
Every function returns a lazy DataFrame built from built-in Catalyst expressions.
"""

__version__ = "0.1.0"

from transitlens.functions import Box, TimeWindow
from transitlens.operators import (
    at_speed,
    clock_window,
    day_clock_window,
    day_window,
    drop_outliers,
    faster_than,
    line_mean,
    restrict,
    slower_than,
    speed_stats,
    time_extent,
)
from transitlens.plans import (
    Report,
    ReportSpec,
    box_report,
    clock_report,
    day_clock_report,
    days_report,
    full_report,
    preview,
    report,
    report_long,
)
from transitlens.schema import PING_SCHEMA, RAW_SCHEMA
from transitlens.sources import (
    day_paths,
    load_day_folders,
    load_event_pings,
    load_partitioned,
    load_pings,
    parse_lines,
    window_paths,
    write_day_files,
    write_partitioned,
)

__all__ = [
    "Box",
    "PING_SCHEMA",
    "RAW_SCHEMA",
    "Report",
    "ReportSpec",
    "TimeWindow",
    "at_speed",
    "box_report",
    "clock_report",
    "clock_window",
    "day_clock_report",
    "day_clock_window",
    "day_paths",
    "day_window",
    "days_report",
    "drop_outliers",
    "faster_than",
    "full_report",
    "line_mean",
    "load_day_folders",
    "load_event_pings",
    "load_partitioned",
    "load_pings",
    "parse_lines",
    "preview",
    "report",
    "report_long",
    "restrict",
    "slower_than",
    "speed_stats",
    "time_extent",
    "window_paths",
    "write_day_files",
    "write_partitioned",
]
