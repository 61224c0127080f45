"""Helpers on DataFrames: saved tables, membership maps of bounded size."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transitlens.llm.kernels import Bitmap
from transitlens.session import scratch_path

_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CELL = 15  # bits of a position that one row of a map holds
MAP_BITS = (24, 27)  # least and largest size of a map, as powers of two


def reach(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it lies. On a
    cluster ship it with ``--py-files`` as usual; the extra path is then harmless."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    # batches of whole texts are bounded by bytes, not by 10,000 rows, unless the cluster says how
    if not spark.sparkContext.getConf().contains(_ARROW_BYTES):
        spark.conf.set(_ARROW_BYTES, "4m")


def saved(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """Write a table into the shared folder of ``spark.checkpoint.dir`` and read it back:
    cuts the lineage, and survives the loss of any executor. ``per_file``: rows of a file at
    most, for rows of many MB, of which a reader else takes thousands at once; 0: as the session says."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    writer = df.write.option("maxRecordsPerFile", per_file) if per_file else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cells(batches):
    """The bits of a cell as bytes."""
    for batch in batches:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy()
        low = lists.flatten().to_numpy()
        packed = []
        for lo, hi in zip(ends[:-1] - ends[0], ends[1:] - ends[0]):
            bits = np.zeros(1 << _CELL, dtype=np.uint8)
            bits[low[lo:hi]] = 1
            packed.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["cell", "bits"])


def bitmap(df: DataFrame, hashed: Column) -> Bitmap:
    """The map of all values of a 64-bit hash column. Its size follows from the number of rows,
    16 bits or more each up to MAP_BITS[1]; with more rows it leaves fewer rows out. The bits are
    packed on the executors; 2**MAP_BITS[1] bits (16 MB) at most reach the driver."""
    least, most = MAP_BITS
    rows = df.select(hashed.alias("h")).where(F.col("h").isNotNull())
    bits = min(most, max(least, (16 * rows.count()).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    cells = (
        rows.select(at.alias("at"))
        .groupBy(F.shiftright("at", _CELL).alias("cell"))
        .agg(F.collect_set(F.col("at").bitwiseAND((1 << _CELL) - 1).cast("int")).alias("low"))
        .mapInArrow(_cells, "cell long, bits binary")
    )
    packed = np.zeros((1 << bits) // 8, dtype=np.uint8)
    width = (1 << _CELL) // 8
    for cell, held in cells.collect():
        packed[cell * width : (cell + 1) * width] = np.frombuffer(held, np.uint8)
    return Bitmap(packed)
