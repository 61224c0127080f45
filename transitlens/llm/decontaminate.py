"""Benchmark decontamination as a prefix-filtered set join.

A window is ``window`` consecutive words of an item (a shorter item is one window). As a set,
a window is its word shingles. A document that holds the window holds all of them, so one
shingle of each window is a sufficient prefix: shingles are ordered by how often they occur in
the documents, the rarest is joined, and windows with a shingle that never occurs are dropped
before the join. The shingle's place in the window gives the one start in the document that
can match (positional bound), and the window must fit between the text's ends (length bound).
Candidates are verified word by word over the item-sized window.

One pass reads the texts. A bitmap of all item shingles (sized by their number, 16 MB at most)
leaves out the words that no item has; what remains is counted and joined by shuffles, so neither
table has to fit anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.tables import bitmap, reach, saved

WINDOW = 10
SHINGLE = 5
_SEEN = 1 << 18


def _windows(window: int, shingle: int):
    """Per window of an item: its word hashes and its shingles, in order."""

    def run(batches):
        for piece in K.slices(batches):
            data, offsets = K.buffers(piece.column("text"))
            h, text, _, _ = K.words(data, offsets, K.ALNUM)
            first, count = K.first_words(text, piece.num_rows)
            ids = piece.column("item_id")
            item, words, tokens = [], [], []
            for i in np.flatnonzero(count):
                w = h[first[i] : first[i] + count[i]]
                length = min(window, len(w))
                s, _ = K.shingles(w, np.zeros(len(w), np.int64), min(shingle, length))
                for at in range(len(w) - length + 1):
                    item.append(ids[i].as_py())
                    words.append(w[at : at + length].view(np.int64))
                    tokens.append(s[at : at + length - min(shingle, length) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(item, ids.type),
                    pa.array(words, pa.list_(pa.int64())),
                    pa.array(tokens, pa.list_(pa.int64())),
                ],
                ["item_id", "words", "tokens"],
            )

    return run


def _scan(window: int, shingle: int, widths: list[int], wanted: K.Bitmap):
    """Per document a row with its length and the hash of its word sequence; per shingle of
    a new word sequence that an item may have, a row with its place and the words around."""
    before = window - shingle
    around = before + window

    def run(batches):
        seen: set = set()
        for piece in K.slices(batches):
            data, offsets = K.buffers(piece.column("text"))
            h, text, _, _ = K.words(data, offsets, K.ALNUM)
            rows = piece.num_rows
            first, count = K.first_words(text, rows)
            key = np.zeros(rows, dtype=np.uint64)
            full = np.flatnonzero(count)
            if len(full):
                place = (np.arange(len(h)) - first[text]).astype(np.uint64)
                key[full] = K.mix(np.add.reduceat(K.mix(h + K.mix(place)), first[full]) + count[full].astype(np.uint64))
            keys = key.view(np.int64)
            none = pa.nulls(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("text_hash"),
                    pa.array(count, pa.int64()),
                    pa.array(keys),
                    none,
                    none,
                    pa.nulls(rows, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_words", "key", "token", "at", "around"],
            )
            fresh = np.zeros(rows, dtype=bool)
            _, one = np.unique(keys, return_index=True)
            fresh[[i for i in one if count[i] and int(keys[i]) not in seen]] = True
            if len(seen) > _SEEN:
                seen.clear()
            seen.update(keys[fresh].tolist())
            for width in widths:
                s, at = K.shingles(h, text, width)
                hit = np.flatnonzero(wanted.has(s))
                hit = hit[fresh[text[at[hit]]]]
                if not len(hit):
                    continue
                s, at = s[hit], at[hit]
                near = at[:, None] + np.arange(-before, window)
                inside = (near >= 0) & (near < len(h))
                near = np.where(inside, near, 0)
                inside &= text[near] == text[at][:, None]
                context = np.where(inside, h[near], np.uint64(0)).view(np.int64)
                n = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.int64()),
                        pa.array(keys[text[at]]),
                        pa.array(s.view(np.int64)),
                        pa.array(at - first[text[at]], pa.int64()),
                        K.lists(context.ravel(), np.full(n, around), pa.int64()),
                    ],
                    ["doc_id", "text_hash", "n_words", "key", "token", "at", "around"],
                )

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of an item window), n_items (items
    with an occurring window), items_sha256 (hash of their ids, sorted as strings and joined
    by commas), contaminated (n_hit > 0), and text_hash (xxhash64 of the text) for joins back.

    Words are runs of ASCII letters, digits and non-ASCII characters, compared with A-Z as
    a-z. Null and wordless texts have no words, no hits and the hash of the empty string;
    wordless items match nothing. Rows that share a doc_id or a text each get a row. Items
    that share an id count as one; an item without an id marks words but is not listed. Other
    columns are ignored; empty tables give no rows, or rows without hits.
    """
    reach(docs.sparkSession)
    if not 0 < shingle <= window:
        raise ValueError("shingle must lie between 1 and window")
    items = saved(
        benchmark.select("item_id", "text").mapInArrow(
            _windows(window, shingle),
            f"item_id {dict(benchmark.dtypes)['item_id']}, words array<long>, tokens array<long>",
        ),
        "windows",
    )
    widths = sorted(
        r[0] for r in items.select(F.least(F.size("words"), F.lit(shingle)).alias("w")).distinct().collect()
    )  # at most `shingle` of them
    wanted = bitmap(items.select(F.explode("tokens").alias("t")).distinct(), F.col("t"))
    scan = saved(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
            _scan(window, shingle, widths, wanted),
            "doc_id long, text_hash long, n_words long, key long, token long, at long, around array<long>",
        ),
        "shingles",
    )
    hits = scan.where(F.col("token").isNotNull()).select("key", "token", "at", "around")
    often = hits.groupBy("token").agg(F.count("*").alias("df"))

    # the rarest shingle of each distinct window; a window with one that never occurs can't
    distinct = items.select("words", "tokens").distinct()
    prefix = (
        distinct.select("words", F.posexplode("tokens").alias("offset", "token"))
        .join(often, "token", "left")
        .groupBy("words")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("rarest"))
        .where("rarest.df > 0")
        .select("words", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))
    )
    before = window - shingle
    found = saved(
        hits.join(prefix, "token")
        .where(F.expr(f"at >= offset AND slice(around, {before + 1} - offset, size(words)) = words"))
        .select("key", (F.col("at") - F.col("offset")).alias("start"), "words")
        .distinct(),
        "found",
    )
    spans = found.select("key", "start", (F.col("start") + F.size("words")).alias("stop"))
    w = Window.partitionBy("key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        spans.withColumn("reached", F.coalesce(F.max("stop").over(w), F.lit(0)))
        .groupBy("key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("n_hit"))
    )
    named = (
        found.select("key", "words").distinct()
        .join(items.where(F.col("item_id").isNotNull()).select("words", "item_id").distinct(), "words")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    # a table of its own, so that the copies of one text are no fixed partition of the last join
    hit = saved(
        covered.join(named, "key", "left").select(
            "key",
            "n_hit",
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ","), 256).alias("listed"),
        ),
        "hits",
    )
    return (
        scan.where(F.col("token").isNull())
        .select("doc_id", "text_hash", "n_words", "key")
        .join(hit, "key", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("listed", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
            "text_hash",
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of any item."""
    hit = contamination(docs, benchmark, **settings).where("contaminated").select("text_hash").distinct()
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("text").alias("h"))
    return tagged.join(saved(hit, "contaminated"), F.col("h") == F.col("text_hash"), "left_anti").select("row.*")
