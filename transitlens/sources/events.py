"""Adapter from the generic ``events`` table to the ping table.

The supplied benchmark tables hold no vehicle positions, so pings are derived column by
column from ``events`` (one ping per event, nothing filtered). The mapping is fixed and
mirrored in the DuckDB oracle:

=========  =====================================================================
bus_id     ``event_id`` as text
bus_line   ``user_id % 20`` as text
latitude   ``(-23100 + (user_id * 37) % 400) / 1000``
longitude  ``(-43700 + (user_id * 53) % 600) / 1000``
speed      0 when ``event_id % 10 = 0`` (a stopped vehicle), else ``value``
datetime   ``ts`` truncated to the second
=========  =====================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from transitlens.functions.columns import truncate_to_second
from transitlens.operators.filters import drop_outliers


def pings_from_events(events: DataFrame) -> DataFrame:
    """Raw (not yet outlier-filtered) pings, one per event. Projection only: no shuffle."""
    user = F.col("user_id")
    event = F.col("event_id")
    return events.select(
        event.cast("string").alias("bus_id"),
        (user % F.lit(20)).cast("string").alias("bus_line"),
        ((F.lit(-23100) + (user * F.lit(37)) % F.lit(400)).cast("double") / F.lit(1000.0)).alias(
            "latitude"
        ),
        ((F.lit(-43700) + (user * F.lit(53)) % F.lit(600)).cast("double") / F.lit(1000.0)).alias(
            "longitude"
        ),
        F.when(event % F.lit(10) == F.lit(0), F.lit(0.0))
        .otherwise(F.col("value"))
        .alias("speed"),
        truncate_to_second(F.col("ts")).alias("datetime"),
    )


def load_event_pings(spark: SparkSession, sf_dir: str, clean: bool = True) -> DataFrame:
    """Pings derived from ``{sf_dir}/events.parquet``; outliers dropped unless ``clean=False``."""
    raw = pings_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return drop_outliers(raw) if clean else raw
