"""

``entry(spark)`` runs the flagship query (the full report) on sf0.001; ``queries()`` maps
same query as DuckDB SQL over the pre-registered tables.

The supplied tables hold no vehicle positions, so every query starts from pings derived
from ``events`` (see ``transitlens.sources.events``; the SQL mirror is ``_PINGS_SQL``).
The source keys read those pings back from raw text day files; every other key reads
them from the normalised day-partitioned Parquet layout. Both copies are written once
per session into the shared scratch folder (``spark.checkpoint.dir``). Floating
statistics are rounded to 6 decimals here, in the driver entries only, never in the
library.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable
from datetime import date

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from transitlens import (  # noqa: E402
    Box,
    at_speed,
    box_report,
    clock_report,
    clock_window,
    day_clock_report,
    day_clock_window,
    day_paths,
    day_window,
    days_report,
    drop_outliers,
    faster_than,
    full_report,
    line_mean,
    load_day_folders,
    load_event_pings,
    load_partitioned,
    load_pings,
    preview,
    restrict,
    slower_than,
    speed_stats,
    time_extent,
    write_day_files,
    write_partitioned,
)
from transitlens.functions.columns import compose_datetime  # noqa: E402
from transitlens.schema import PING_COLUMNS  # noqa: E402
from transitlens.session import scratch_path  # noqa: E402
from transitlens.sources.text import read_raw  # noqa: E402


def _if_there(name: str):
    """A module, or None where it or its package was left out."""
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as missing:
        if missing.name != name and not name.startswith(f"{missing.name}."):
            raise
        return None


# the training-data operators, and the pipeline made of them, may each be left out
_llm = _if_there("transitlens.llm.queries")
_pipeline = _if_there("corpus_pipeline") if _llm else None

SMOKE_DIR = "/root/testdata/sf0.001"

BOX = Box(east=-43.2, west=-43.4, north=-22.8, south=-23.0)
YEAR, MONTH = 2024, 1
DAY1, DAY2 = 5, 20
CLOCK1, CLOCK2 = "08:00:00", "17:00:00"
DAY_FILES = (date(2024, 1, 1), date(2024, 1, 3))
LISTED_DAYS = ("2024-01-02", "2024-01-01", "2024-01-03")
SLOW_BELOW, FAST_BOX, FAST_WINDOW, EXACT = 10.0, 50.0, 100.0, 0.0

WINDOW = day_window(DAY1, DAY2, YEAR, MONTH)
DAY_CLOCK = day_clock_window(DAY1, DAY2, CLOCK1, CLOCK2, YEAR, MONTH)
PREVIEW_ORDER = ["datetime", "bus_line", "speed", "bus_id", "latitude", "longitude"]
ROUNDED = ("mean_speed", "variance_speed", "stddev_speed")


def _round(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.round(F.col(c), 6).alias(c) if c in ROUNDED else F.col(c) for c in df.columns]
    )


_MEMO: dict[tuple, tuple[SparkSession, object]] = {}


def _memo(spark: SparkSession, key: tuple, build: Callable[[], object]):
    """One build per session and key (the session object itself is checked, so a new
    session never sees an old one's plans or folders)."""
    hit = _MEMO.get((id(spark), *key))
    if hit is None or hit[0] is not spark:
        hit = (spark, build())
        _MEMO[(id(spark), *key)] = hit
    return hit[1]


def _event_pings(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """The derived ping table, planned once per session and folder (a lazy plan, no data
    cached)."""
    return _memo(spark, ("events", sf_dir, clean), lambda: load_event_pings(spark, sf_dir, clean))


def _pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean derived pings in the normalised day-partitioned Parquet layout.

    Written once per session into the shared scratch folder, as a user would normalise
    day files once and then query them many times: every query after that gets its time
    bounds as partition pruning plus Parquet pushdown and its box bounds as row-group
    skipping, which the derived columns of ``events`` cannot offer.
    """

    def build() -> DataFrame:
        path = write_partitioned(_event_pings(spark, sf_dir), scratch_path(spark, "pings-layout"), by_day=True)
        return load_partitioned(spark, path)

    return _memo(spark, ("layout", sf_dir), build)


def _raw_text(spark: SparkSession, sf_dir: str) -> str:
    """The raw derived pings written once per session as headerless comma text, one folder
    per day (``day=YYYY-MM-DD``), in the shared scratch folder. The source keys read it
    back through the text sources."""
    return _memo(
        spark,
        ("text", sf_dir),
        lambda: write_day_files(_event_pings(spark, sf_dir, clean=False), scratch_path(spark, "raw-day-files")),
    )


def _scan_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_pings(spark, _raw_text(spark, sf_dir))


def _ts_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_raw(spark, _raw_text(spark, sf_dir))
    return drop_outliers(raw).select(
        "bus_id", "date", "time", compose_datetime(F.col("date"), F.col("time")).alias("datetime")
    )


def _scan_day_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_pings(spark, day_paths(_raw_text(spark, sf_dir) + "/day=%Y-%m-%d", *DAY_FILES))


def _clock_window_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock window whose first and last day are those of the first and last row in the order
    in which the day files are listed."""
    pings = load_pings(spark, [f"{_raw_text(spark, sf_dir)}/day={day}" for day in LISTED_DAYS])
    return _round(speed_stats(pings, window=clock_window(pings, CLOCK1, CLOCK2, extent="file_order")))


def _with_pings(fn: Callable[[DataFrame], DataFrame], rounded: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(_pings(spark, sf_dir))
        return _round(out) if rounded else out

    return run


def _rows(df: DataFrame) -> DataFrame:
    """The ping columns (drops the layout's day partition column)."""
    return df.select(*PING_COLUMNS)


def _clock_stats(p: DataFrame) -> DataFrame:
    return speed_stats(p, window=clock_window(p, CLOCK1, CLOCK2))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query; each takes (spark, sf_dir)."""
    return ping_queries() | (_llm.queries() if _llm else {}) | ({"pipeline": _pipeline.run} if _pipeline else {})


def ping_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "scan_parse": _scan_parse,
        "ts_compose": _ts_compose,
        "scan_day_union": _scan_day_union,
        "outlier_filter": lambda spark, d: drop_outliers(_event_pings(spark, d, clean=False)),
        "box_filter": _with_pings(lambda p: _rows(restrict(p, box=BOX))),
        "window_filter": _with_pings(lambda p: _rows(restrict(p, window=WINDOW))),
        "window_day_folders": lambda spark, d: load_day_folders(spark, _raw_text(spark, d), WINDOW),
        "box_window_filter": _with_pings(lambda p: _rows(restrict(p, box=BOX, window=WINDOW))),
        "line_mean_box": _with_pings(lambda p: line_mean(p, box=BOX), rounded=True),
        "line_mean_window": _with_pings(lambda p: line_mean(p, window=WINDOW), rounded=True),
        "line_mean_box_window": _with_pings(
            lambda p: line_mean(p, box=BOX, window=WINDOW), rounded=True
        ),
        "speed_stats_box": _with_pings(lambda p: speed_stats(p, box=BOX), rounded=True),
        "speed_stats_window": _with_pings(lambda p: speed_stats(p, window=WINDOW), rounded=True),
        "speed_stats_box_window": _with_pings(
            lambda p: speed_stats(p, box=BOX, window=WINDOW), rounded=True
        ),
        "slow_box": _with_pings(lambda p: slower_than(p, SLOW_BELOW, box=BOX)),
        "slow_window": _with_pings(lambda p: slower_than(p, SLOW_BELOW, window=WINDOW)),
        "slow_box_window": _with_pings(
            lambda p: slower_than(p, SLOW_BELOW, box=BOX, window=WINDOW)
        ),
        "fast_box": _with_pings(lambda p: faster_than(p, FAST_BOX, box=BOX)),
        "fast_window": _with_pings(lambda p: faster_than(p, FAST_WINDOW, window=WINDOW)),
        "fast_box_window": _with_pings(
            lambda p: faster_than(p, FAST_WINDOW, box=BOX, window=WINDOW)
        ),
        "exact_box": _with_pings(lambda p: at_speed(p, EXACT, box=BOX)),
        "exact_window": _with_pings(lambda p: at_speed(p, EXACT, window=WINDOW)),
        "exact_box_window": _with_pings(lambda p: at_speed(p, EXACT, box=BOX, window=WINDOW)),
        "time_extent": _with_pings(time_extent),
        "clock_window_stats": _with_pings(_clock_stats, rounded=True),
        "clock_window_file_order": _clock_window_file_order,
        "day_window_stats": _with_pings(lambda p: speed_stats(p, window=WINDOW), rounded=True),
        "day_clock_window_stats": _with_pings(
            lambda p: speed_stats(p, window=DAY_CLOCK), rounded=True
        ),
        "report_box": _with_pings(lambda p: box_report(p, BOX).long(), rounded=True),
        "report_clock": _with_pings(
            lambda p: clock_report(p, CLOCK1, CLOCK2).long(), rounded=True
        ),
        "report_clock_text": lambda spark, d: _round(
            clock_report(load_pings(spark, _raw_text(spark, d)), CLOCK1, CLOCK2).long()
        ),
        "report_days": _with_pings(
            lambda p: days_report(p, DAY1, DAY2, YEAR, MONTH).long(), rounded=True
        ),
        "report_day_clock": _with_pings(
            lambda p: day_clock_report(p, DAY1, DAY2, CLOCK1, CLOCK2, YEAR, MONTH).long(),
            rounded=True,
        ),
        "report_all": _with_pings(
            lambda p: full_report(p, BOX, DAY1, DAY2, CLOCK1, CLOCK2, YEAR, MONTH).long(),
            rounded=True,
        ),
        "preview_top20": _with_pings(lambda p: _rows(preview(p, 20, PREVIEW_ORDER))),
    }


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the full report (box + day/clock window) in long form on sf0.001."""
    return queries()["report_all"](spark, SMOKE_DIR)


# ---------------------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------------------

_PINGS_SQL = """
pings AS (
  SELECT CAST(event_id AS VARCHAR) AS bus_id,
         CAST(user_id % 20 AS VARCHAR) AS bus_line,
         CAST(-23100 + (user_id * 37) % 400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
         CAST(-43700 + (user_id * 53) % 600 AS DOUBLE) / CAST(1000 AS DOUBLE) AS longitude,
         CASE WHEN event_id % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS speed,
         DATE_TRUNC('second', ts) AS datetime
  FROM events
),
clean AS (SELECT * FROM pings WHERE speed <= CAST(120 AS DOUBLE))
"""

_BOX_SQL = (
    "longitude < CAST(-43.2 AS DOUBLE) AND longitude > CAST(-43.4 AS DOUBLE) "
    "AND latitude < CAST(-22.8 AS DOUBLE) AND latitude > CAST(-23.0 AS DOUBLE)"
)
_WINDOW_SQL = (
    "datetime > TIMESTAMP '2024-01-05 00:00:00' AND datetime < TIMESTAMP '2024-01-20 00:00:00'"
)
_DAY_CLOCK_SQL = (
    "datetime > TIMESTAMP '2024-01-05 08:00:00' AND datetime < TIMESTAMP '2024-01-20 17:00:00'"
)
_CLOCK_EXTENT_SQL = """
extent AS (
  SELECT CAST(CAST(min(datetime) AS DATE) AS TIMESTAMP) + INTERVAL 8 HOUR AS lo,
         CAST(CAST(max(datetime) AS DATE) AS TIMESTAMP) + INTERVAL 17 HOUR AS hi
  FROM clean
)"""
_CLOCK_SQL = "datetime > (SELECT lo FROM extent) AND datetime < (SELECT hi FROM extent)"

_STATS_SELECT = (
    "round(avg(speed), 6) AS mean_speed, round(var_samp(speed), 6) AS variance_speed, "
    "round(stddev_samp(speed), 6) AS stddev_speed, min(speed) AS min_speed, "
    "max(speed) AS max_speed"
)
_OBS = "bus_line, datetime, speed"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([_PINGS_SQL.strip(), *[c.strip() for c in ctes]]) + "\n"


def _where(*conds: str) -> str:
    return "SELECT * FROM clean WHERE " + " AND ".join(f"({c})" for c in conds)


def _line_mean(*conds: str) -> str:
    return (
        _with()
        + "SELECT bus_line, round(avg(speed), 6) AS mean_speed FROM clean WHERE "
        + " AND ".join(f"({c})" for c in conds)
        + " GROUP BY bus_line"
    )


def _stats(*conds: str, extra: tuple[str, ...] = ()) -> str:
    return (
        _with(*extra)
        + f"SELECT {_STATS_SELECT} FROM clean WHERE "
        + " AND ".join(f"({c})" for c in conds)
    )


def _observe(speed_cond: str, *conds: str) -> str:
    return (
        _with()
        + f"SELECT {_OBS} FROM clean WHERE ({speed_cond}) AND "
        + " AND ".join(f"({c})" for c in conds)
    )


def _report(conds: tuple[str, ...], observations: tuple[tuple[str, str], ...], extra=()) -> str:
    restricted = "f AS (SELECT bus_line, datetime, speed FROM clean WHERE " + " AND ".join(
        f"({c})" for c in conds
    ) + ")"
    nulls_obs = "CAST(NULL AS TIMESTAMP) AS datetime, CAST(NULL AS DOUBLE) AS speed"
    nulls_stats = ", ".join(
        f"CAST(NULL AS DOUBLE) AS {c}"
        for c in ("variance_speed", "stddev_speed", "min_speed", "max_speed")
    )
    all_nulls = ", ".join(
        f"CAST(NULL AS DOUBLE) AS {c}"
        for c in ("mean_speed", "variance_speed", "stddev_speed", "min_speed", "max_speed")
    )
    parts = [
        f"SELECT 'stats' AS section, CAST(NULL AS VARCHAR) AS bus_line, {nulls_obs}, "
        f"{_STATS_SELECT} FROM f",
        f"SELECT 'line_means' AS section, bus_line, {nulls_obs}, "
        f"round(avg(speed), 6) AS mean_speed, {nulls_stats} FROM f GROUP BY bus_line",
    ]
    for name, cond in observations:
        parts.append(f"SELECT '{name}' AS section, {_OBS}, {all_nulls} FROM f WHERE {cond}")
    return _with(*extra, restricted) + "\nUNION ALL\n".join(parts)


_SLOW = "speed < CAST(10 AS DOUBLE)"
_FAST_BOX = "speed > CAST(50 AS DOUBLE)"
_FAST_WINDOW = "speed > CAST(100 AS DOUBLE)"
_EXACT = "speed = CAST(0 AS DOUBLE)"
_BOX_REPORT_OBS = (("slow", _SLOW), ("fast", _FAST_BOX))
_WINDOW_REPORT_OBS = (("exact", _EXACT), ("fast", _FAST_WINDOW))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every query that SQL expresses (same column names and rounding)."""
    known = ping_oracle_sql() | (_llm.oracle_sql() if _llm else {})
    if _pipeline and _pipeline.ORACLE_SQL:
        known["pipeline"] = _pipeline.ORACLE_SQL
    return known


def ping_oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every key of :func:`ping_queries`."""
    return {
        "scan_parse": _with() + "SELECT * FROM clean",
        "ts_compose": _with()
        + "SELECT bus_id, strftime(datetime, '%m-%d-%Y') AS date, "
        "strftime(datetime, '%H:%M:%S') AS time, datetime FROM clean",
        "scan_day_union": _with()
        + "SELECT * FROM clean WHERE CAST(datetime AS DATE) "
        "BETWEEN DATE '2024-01-01' AND DATE '2024-01-03'",
        "outlier_filter": _with() + "SELECT * FROM pings WHERE speed <= CAST(120 AS DOUBLE)",
        "box_filter": _with() + _where(_BOX_SQL),
        "window_filter": _with() + _where(_WINDOW_SQL),
        "window_day_folders": _with() + _where(_WINDOW_SQL),
        "box_window_filter": _with() + _where(_BOX_SQL, _WINDOW_SQL),
        "line_mean_box": _line_mean(_BOX_SQL),
        "line_mean_window": _line_mean(_WINDOW_SQL),
        "line_mean_box_window": _line_mean(_BOX_SQL, _WINDOW_SQL),
        "speed_stats_box": _stats(_BOX_SQL),
        "speed_stats_window": _stats(_WINDOW_SQL),
        "speed_stats_box_window": _stats(_BOX_SQL, _WINDOW_SQL),
        "slow_box": _observe(_SLOW, _BOX_SQL),
        "slow_window": _observe(_SLOW, _WINDOW_SQL),
        "slow_box_window": _observe(_SLOW, _BOX_SQL, _WINDOW_SQL),
        "fast_box": _observe(_FAST_BOX, _BOX_SQL),
        "fast_window": _observe(_FAST_WINDOW, _WINDOW_SQL),
        "fast_box_window": _observe(_FAST_WINDOW, _BOX_SQL, _WINDOW_SQL),
        "exact_box": _observe(_EXACT, _BOX_SQL),
        "exact_window": _observe(_EXACT, _WINDOW_SQL),
        "exact_box_window": _observe(_EXACT, _BOX_SQL, _WINDOW_SQL),
        "time_extent": _with()
        + "SELECT min(datetime) AS first_datetime, max(datetime) AS last_datetime FROM clean",
        "clock_window_stats": _stats(_CLOCK_SQL, extra=(_CLOCK_EXTENT_SQL,)),
        "clock_window_file_order": _stats(
            "CAST(datetime AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-03'",
            "datetime > TIMESTAMP '2024-01-02 08:00:00' AND datetime < TIMESTAMP '2024-01-03 17:00:00'",
        ),
        "day_window_stats": _stats(_WINDOW_SQL),
        "day_clock_window_stats": _stats(_DAY_CLOCK_SQL),
        "report_box": _report((_BOX_SQL,), _BOX_REPORT_OBS),
        "report_clock": _report((_CLOCK_SQL,), _WINDOW_REPORT_OBS, extra=(_CLOCK_EXTENT_SQL,)),
        "report_clock_text": _report((_CLOCK_SQL,), _WINDOW_REPORT_OBS, extra=(_CLOCK_EXTENT_SQL,)),
        "report_days": _report((_WINDOW_SQL,), _WINDOW_REPORT_OBS),
        "report_day_clock": _report((_DAY_CLOCK_SQL,), _WINDOW_REPORT_OBS),
        "report_all": _report((_BOX_SQL, _DAY_CLOCK_SQL), _WINDOW_REPORT_OBS),
        "preview_top20": _with()
        + "SELECT * FROM clean ORDER BY datetime NULLS FIRST, bus_line NULLS FIRST, "
        "speed NULLS FIRST, bus_id NULLS FIRST, latitude NULLS FIRST, longitude NULLS FIRST "
        "LIMIT 20",
    }
