"""Day files arriving over time, read as a stream.

The batch program reads a fixed set of day files. The same parsing and outlier rule run
unchanged on Spark's file stream source, so a new day file dropped into the folder is
picked up by the next micro-batch. Filters and observation lists are stateless and work
on the stream as they are; the aggregates (:func:`~transitlens.line_mean`,
:func:`~transitlens.speed_stats`) run as streaming aggregations in ``complete`` or
``update`` mode. A file sink's checkpoint lies with its output, so a restarted query resumes
where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from transitlens.functions.predicates import Box, TimeWindow
from transitlens.operators.filters import restrict
from transitlens.plans.report import ReportSpec, observation_rows
from transitlens.schema import MAX_PLAUSIBLE_SPEED, OBSERVATION_COLUMNS, RAW_SCHEMA
from transitlens.session import scratch_path
from transitlens.sources.text import CSV_OPTIONS, clean


def read_ping_stream(
    spark: SparkSession,
    directory: str,
    max_files_per_trigger: int | None = None,
    max_speed: float = MAX_PLAUSIBLE_SPEED,
) -> DataFrame:
    """A streaming ping table over the day files in ``directory`` (same schema and rules
    as :func:`~transitlens.sources.text.load_pings`)."""
    reader = spark.readStream.options(**CSV_OPTIONS).schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return clean(reader.csv(directory), max_speed)


def observation_stream(
    pings: DataFrame,
    spec: ReportSpec,
    box: Box | None = None,
    window: TimeWindow | None = None,
) -> DataFrame:
    """The observation sections of a report (``slow`` / ``exact`` / ``fast``) as one
    stateless stream of ``section, bus_line, datetime, speed`` rows."""
    part = observation_rows(restrict(pings, box, window).select(*OBSERVATION_COLUMNS), spec)
    if part is None:
        raise ValueError("the report spec has no observation section")
    return part


def start(
    stream: DataFrame,
    name: str,
    output_mode: str = "append",
    sink: str = "memory",
    path: str | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Start ``stream`` into ``sink``.

    A file sink keeps its checkpoint with its output (``<path>/_checkpoint``), so that a query
    started again on the same output goes on where it stopped. A sink without a path starts
    anew each time, with a checkpoint in the shared scratch folder. ``checkpoint`` overrides
    either.
    """
    if checkpoint is None:
        checkpoint = f"{path.rstrip('/')}/_checkpoint" if path else scratch_path(stream.sparkSession, f"stream-{name}")
    writer = (
        stream.writeStream.queryName(name)
        .outputMode(output_mode)
        .format(sink)
        .option("checkpointLocation", checkpoint)
    )
    if path is not None:
        writer = writer.option("path", path)
    return writer.start()
