"""Composed reports and plan inspection."""

from transitlens.plans.report import (
    BOX_SPEC,
    LONG_COLUMNS,
    LONG_SCHEMA,
    WINDOW_SPEC,
    Report,
    ReportSpec,
    aggregate_rows,
    box_report,
    clock_report,
    day_clock_report,
    days_report,
    full_report,
    observation_rows,
    preview,
    report,
    report_long,
)

__all__ = [
    "BOX_SPEC",
    "LONG_COLUMNS",
    "LONG_SCHEMA",
    "WINDOW_SPEC",
    "Report",
    "ReportSpec",
    "aggregate_rows",
    "box_report",
    "clock_report",
    "day_clock_report",
    "days_report",
    "full_report",
    "observation_rows",
    "preview",
    "report",
    "report_long",
]
