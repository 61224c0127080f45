"""Sources and sinks of the ping table: raw day files, day-partitioned Parquet, and the
adapter from the generic ``events`` table."""

from transitlens.sources.events import load_event_pings, pings_from_events
from transitlens.sources.parquet import load_partitioned, write_partitioned
from transitlens.sources.text import (
    CSV_OPTIONS,
    clean,
    day_paths,
    line_expr,
    load_day_folders,
    load_pings,
    parse_lines,
    read_raw,
    split_lines,
    to_lines,
    window_paths,
    write_day_files,
)

__all__ = [
    "CSV_OPTIONS",
    "clean",
    "day_paths",
    "line_expr",
    "load_day_folders",
    "load_event_pings",
    "load_partitioned",
    "load_pings",
    "parse_lines",
    "pings_from_events",
    "read_raw",
    "split_lines",
    "to_lines",
    "window_paths",
    "write_day_files",
    "write_partitioned",
]
