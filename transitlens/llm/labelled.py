"""Labelled documents for fitting classifiers: all ids with their labels, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transitlens.llm.tables import saved

SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 100_000


def fold(modulus: int, remainder: int) -> Column:
    """Whether a doc_id falls into the held-out fold; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def known(labels: DataFrame, label: str, held_out: Column) -> DataFrame:
    """(doc_id, y, h) of every labelled doc_id that isn't held out, h a hash of it. Where a doc_id
    has several labels, the largest counts. Labels other than 0 and 1 are left out."""
    return (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id").agg(F.max(label).alias("y"))
        .withColumn("h", F.xxhash64("doc_id"))
    )


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column,
           rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(h, y, text) of at most ``rows`` labelled documents that aren't held out: those with the
    smallest hash of their doc_id, of texts of at most ``chars`` characters. Where a doc_id has
    several labels or texts, the largest counts. Labels other than 0 and 1 are left out."""
    some = saved(known(labels, label, held_out).orderBy("h", "doc_id").limit(rows), "labels")
    texts = (
        docs.select("doc_id", "text")
        .join(F.broadcast(some), "doc_id")  # `rows` rows
        .where(F.length("text") <= chars)
        .groupBy("doc_id", "h", "y").agg(F.max("text").alias("text"))
    )
    return texts.select("h", F.col("y").cast("int").alias("y"), "text")
