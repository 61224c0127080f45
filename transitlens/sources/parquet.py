"""Day-partitioned Parquet layout of the ping table.

Normalising the text day files once to Parquet gives the scans what text cannot: typed
columnar reads of only the needed columns, row-group min/max skipping, and partition
pruning of whole days by :class:`~transitlens.functions.predicates.TimeWindow`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from transitlens.functions.columns import position_key, service_date
from transitlens.schema import PARTITIONED_SCHEMA, PING_COLUMNS, SERVICE_DATE

# Sort order inside every file: rows of one day, by position, so that each row group and
# each page carries tight position bounds that box queries can skip on. Spark's Parquet
# readers use the page index; see
# tests/test_plans.py::test_sorted_latitude_lets_the_reader_skip_pages.
#
# Two position orders, measured on the sf0.1 pings:
# - "latitude" (the default) makes each page a narrow latitude band. It wins when files
#   hold few pages. On the day files here (about 3k rows, a few pages each), the two test
#   boxes scanned 60,000 and 17,000 rows; with the other order they scanned 75,545 and
#   45,500.
# - "zorder" sorts by an interleaved latitude/longitude key (position_key), so a page
#   bounds a small area in both directions. It wins when files hold many pages, as
#   32-128 MB files do at scale. On one 100k-row file with 2,000-row pages, the two test
#   boxes scanned 30,790 and 5,958 rows against 46,667 and 11,908.
POSITION_ORDERS = {
    "latitude": ("latitude", "longitude"),
    "zorder": ("_position",),
}


def write_partitioned(
    pings: DataFrame,
    path: str,
    mode: str = "errorifexists",
    compact: bool = False,
    by_day: bool = False,
    num_partitions: int | None = None,
    max_records_per_file: int = 5_000_000,
    compression: str = "zstd",
    row_group_bytes: int = 32 * 1024 * 1024,
    position_order: str = "latitude",
) -> str:
    """Write pings to ``path/ping_layout_day=YYYY-MM-DD/*.parquet``.

    By default there is no shuffle: every input split (bounded by
    ``spark.sql.files.maxPartitionBytes``) sorts its own rows and writes one file per day
    it holds, so no task ever receives more than one split, however the rows are skewed.
    For time-ordered day files that is about one file per split. Input that is not ordered by
    time would give splits x days files; use ``by_day`` or ``compact`` for it.

    ``by_day=True`` rebalances by day first: adaptive execution merges small days into one
    task and cuts a day above ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` into
    several, so unordered input gives about one file per day and a hot day is still shared
    out. One shuffle of the data, no count and no sampling.

    ``compact=True`` range-partitions first, so each day is cut into few, position-sorted
    files even when the input is unordered. Without ``num_partitions`` the shuffle partition
    count applies, merged by adaptive execution. The range key ends with a per-row id, so a group of
    identical rows (a parked vehicle's repeated pings, duplicated files) is still cut
    across ranges instead of landing in one task. The id depends only on the input split
    and the row's place in it, so a retried task recomputes the same ranges.

    ``compression`` defaults to zstd: smaller files than Spark's default snappy, so less
    I/O on every later scan, at a similar decode speed.

    ``position_order`` is ``"latitude"`` (default, best for files of a few pages) or
    ``"zorder"`` (best for large files of many pages); see ``POSITION_ORDERS``.

    ``row_group_bytes`` defaults to 32 MB rather than Parquet's 128 MB. A file written
    from one 128 MB split then holds several row groups, each a band of latitudes, which
    box queries can skip. A single row group would span the whole latitude range.
    """
    if position_order not in POSITION_ORDERS:
        raise ValueError(f"position_order must be one of {sorted(POSITION_ORDERS)}")
    if compact and by_day:
        raise ValueError("give compact or by_day, not both")
    frame = pings.select(*PING_COLUMNS).withColumn(SERVICE_DATE, service_date(F.col("datetime")))
    file_order = [SERVICE_DATE, *POSITION_ORDERS[position_order], "datetime"]
    if position_order == "zorder":
        frame = frame.withColumn("_position", position_key(F.col("latitude"), F.col("longitude")))
    if compact:
        frame = frame.withColumn("_row", F.monotonically_increasing_id())
        key = [*file_order, "_row"]
        ranged = (
            frame.repartitionByRange(num_partitions, *key)
            if num_partitions
            else frame.repartitionByRange(*key)
        )
        frame = ranged.sortWithinPartitions(*key).drop("_row")
    else:
        if by_day:
            frame = frame.hint("rebalance", SERVICE_DATE)
        frame = frame.sortWithinPartitions(*file_order)
    frame = frame.drop("_position")
    (
        frame.write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .option("compression", compression)
        .option("parquet.block.size", row_group_bytes)
        .partitionBy(SERVICE_DATE)
        .parquet(path)
    )
    return path


def load_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Read the day-partitioned layout (schema declared, partition column typed ``date``).

    The day pruning of windows, extents and previews relies on ``ping_layout_day`` being the
    calendar day of ``datetime`` in every row, which :func:`write_partitioned` guarantees. A
    frame derived from this one keeps the pruning only while both columns are untouched
    (:func:`~transitlens.functions.predicates.day_is_known`).
    """
    return spark.read.schema(PARTITIONED_SCHEMA).parquet(path)
