"""Mixing sources to target weights.

The words of a source, document after document in a hashed order, are packed into blocks of
fixed length. Each source is due a number of slots, enough for its target; how many of them
each output shard gets is one multinomial draw per source (a multinomial mix of sources per
shard, given the totals, so the totals are met exactly). It is drawn in two steps, first for
ranges of shards and then, in tasks of their own, for the shards of a range, which is the same
distribution. A source's slots are numbered through
the shards and mapped to blocks by a pseudorandom permutation of the block numbers, a new one
for each pass over the source. Slots and documents meet in a join on (source, block); the last
slot of a source is cut where its target is reached.

No window sees a whole source: positions in a source come from sums over hash buckets and a
running sum inside each bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.tables import reach, saved

BLOCK = 64  # words
SHARD_SLOTS = 1 << 14  # slots of an output shard
WEIGHTS = (1, 2, 3)
MOST = 3  # times a source, and so a document, may be taken
SEED = 17
_BUCKETS = 1024
_ROUNDS = 4
_CLASSES = 8  # size classes from a length to its double
_SCALE_BITS = 24
_SCALE = 1 << _SCALE_BITS  # a whole copy, in the sums of shares
_TASK_SLOTS = 1 << 18
_RANGE = 1 << 12  # output shards whose slots are drawn together


def permute(p: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. n-1 for each row: a four-round Feistel network on the next
    even number of bits, walked along its cycle until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2)
    while (short := (np.int64(1) << (2 * half)) < n).any():  # rounding of the logarithm
        half = half + short
    half = half.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = p.astype(np.uint64), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    todo = np.arange(len(x))
    rounds = range(_ROUNDS)
    while len(todo):
        b, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> b, x[todo] & m
        with np.errstate(over="ignore"):
            for r in reversed(rounds) if inverse else rounds:
                if inverse:
                    left, right = right ^ (K.mix(left + k + K.mix(np.full(1, r + 1, np.uint64))) & m), left
                else:
                    left, right = right, left ^ (K.mix(right + k + K.mix(np.full(1, r + 1, np.uint64))) & m)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def _epoch_key(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(
            source.astype(np.int64).view(np.uint64) + K.mix(epoch.astype(np.uint64) * np.uint64(2) + np.uint64(2 * seed + 1))
        ).view(np.int64)


def _counts(batches):
    for piece in K.slices(batches):
        data, offsets = K.buffers(piece.column("text"))
        n = K.word_counts(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("source"), piece.column("text_hash"), pa.array(n)],
            ["doc_id", "source", "text_hash", "size"],
        )


def _key(source: Column) -> Column:
    return F.xxhash64(F.coalesce(source, F.lit("")), source.isNull())


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, none above ``most`` times
    its source, the excess reshared by weight. One row per source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")).alias("w"),
        (F.col("source_size") * most).alias("cap"),
    )
    # sources reach their cap in the order of cap / weight
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    rows = rows.select(
        "*",
        (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_left"),
    )
    level = F.col("left") / F.col("w_left")  # if all before this source are capped
    open_ = F.when(F.col("w") * level <= F.col("cap"), level)
    return rows.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(F.max(open_).over(all_rows), F.lit(0.0))).alias("target"),
    )


def _drawn(count: int, widths: np.ndarray, seed: list[int]):
    """One multinomial draw: the places that got any, the number of the first of each, how many."""
    rng = np.random.Generator(np.random.PCG64(seed))
    drawn = rng.multinomial(count, widths / widths.sum())
    some = np.flatnonzero(drawn)
    return some, (np.cumsum(drawn) - drawn)[some], drawn[some]


def _ranges(block: int, shards: int, width: int, seed: int):
    """Per source and range of ``width`` output shards: how many slots, and the number of the first."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                total, due, source = row["source_size"], row["due"], row["s"]
                if not due:
                    continue
                n = -(-total // block)
                short = total - (n - 1) * block
                passes, rest = divmod(due, total)
                key = _epoch_key(np.array([source]), np.array([passes]), seed)
                at = int(permute(np.array([n - 1]), np.array([n]), key, inverse=True)[0])
                slots = -(-rest // block)
                if at < slots and slots * block - (block - short) < rest:
                    slots += 1
                cut = rest - ((slots - 1) * block - (block - short) * (at < slots - 1)) if rest else 0
                count = passes * n + slots
                widths = np.diff(np.r_[np.arange(0, shards, width), shards])
                some, first, slots = _drawn(count, widths, [seed, source & (2**64 - 1)])
                const = lambda v: pa.array(np.full(len(some), v, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [const(source), pa.array(some), pa.array(widths[some]), pa.array(first), pa.array(slots),
                     const(n), const(count), const(cut)],
                    ["s", "range", "shards", "first", "slots", "n", "count", "cut"],
                )

    return run


def _draws(width: int, seed: int):
    """The same per source and output shard, each range drawn by itself."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = [seed, row["s"] & (2**64 - 1), row["range"] + 1]
                some, first, slots = _drawn(row["slots"], np.ones(row["shards"]), at)
                const = lambda v: pa.array(np.full(len(some), v, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [const(row["s"]), pa.array(some + row["range"] * width), pa.array(first + row["first"]),
                     pa.array(slots), const(row["n"]), const(row["count"]), const(row["cut"])],
                    ["s", "shard", "first", "slots", "n", "count", "cut"],
                )

    return run


def draws(goals: DataFrame, slots: int, sources: int, block: int, shard_slots: int, seed: int) -> DataFrame:
    """s, shard, first, slots (the slots ``first`` to ``first + slots - 1`` of the source go to
    this output shard), n (its blocks), count (all its slots), cut (words of the last one, 0 for
    all). ``goals`` has s, source_size and due, a row for each of ``sources`` sources, which are
    due ``slots`` slots together. A task draws for _TASK_SLOTS shards or so."""
    shards = max(1, -(-slots // shard_slots))
    rows = sources * -(-shards // _RANGE)
    ranges = goals.select("s", "source_size", "due").mapInArrow(
        _ranges(block, shards, _RANGE, seed),
        "s long, range long, shards long, first long, slots long, n long, count long, cut long",
    )
    return ranges.repartition(max(1, -(-rows * min(shards, _RANGE) // _TASK_SLOTS)), "s", "range").mapInArrow(
        _draws(_RANGE, seed), "s long, shard long, first long, slots long, n long, count long, cut long"
    )


def _blocks(seed: int):
    """The block that each slot takes; whole, or cut after some words."""

    def run(batches):
        for batch in batches:
            s, slot, n, count, cut = (batch.column(i).to_numpy() for i in range(5))
            epoch = slot // n
            b = permute(slot % n, n, _epoch_key(s, epoch, seed))
            part = np.where((slot == count - 1) & (cut > 0), cut, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s), pa.array(b), pa.array((part == 0).astype(np.int64)), pa.array(part)],
                ["s", "block", "whole", "part"],
            )

    return run


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size (words), source_size, target (of its source), taken (words of the document
    that the mix takes, repeats counted), and source_key and text_hash for joins back.

    Sources by code point, null (a source of its own) last, weigh ``weights`` in turn. The
    words taken of a source are its target rounded to a whole word, and no word is taken more
    than ``most`` times. Null, empty and blank texts have size 0 and are never taken. Rows that
    share a doc_id or a text each get a row. The same rows and seed give the same mix,
    however they are partitioned. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    reach(spark)
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("text_hash"), "text",
    ).mapInArrow(_counts, "doc_id long, source string, text_hash long, size long")
    base = saved(
        counted.select(
            "doc_id", "source", "text_hash", "size", _key(F.col("source")).alias("s"),
            F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash", F.lit(seed)).alias("h"),
        ),
        "sizes",
    )
    sized = base.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    goals = saved(
        targets(sized.select("source", "source_size"), weights, most).select(
            _key(F.col("source")).alias("s"), "source_size", "target",
            F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most).cast("long").alias("due"),
        ),
        "targets",
    )
    # where a document's words lie in its source
    bucket = F.pmod("h", F.lit(_BUCKETS))
    placed = base.where("size > 0").withColumn("bucket", bucket)
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    by_bucket = Window.partitionBy("s").orderBy("bucket")  # at most _BUCKETS rows each
    sums = sums.select("s", "bucket", (F.sum("words").over(by_bucket) - F.col("words")).alias("offset"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = saved(
        placed.withColumn("upto", F.sum("size").over(inside))
        .join(sums, ["s", "bucket"])
        .select("doc_id", "s", "text_hash", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("begin")),
        "placed",
    )
    due, sources = goals.agg(F.sum(F.ceil(F.col("due") / block)), F.count(F.lit(1))).first()
    due = due or 0
    # a count of its own, since the few rows here stand for many slots
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-due // _TASK_SLOTS))
    slots = draws(goals, due, sources, block, shard_slots, seed).repartition(parts, "s", "shard").select(
        "s", F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1)).alias("slot"), "n", "count", "cut"
    )
    taken = (
        slots.mapInArrow(_blocks(seed), "s long, block long, whole long, part long")
        .groupBy("s", "block")
        .agg(F.sum("whole").alias("whole"), F.max("part").alias("part"))
    )
    over = placed.select(
        "s", "begin", "size",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"),
    )
    lo = F.greatest(F.col("begin"), F.col("block") * block)
    hi = lambda end: F.least(F.col("begin") + F.col("size"), F.col("block") * block + end)
    by_doc = (
        over.join(taken.hint("merge"), ["s", "block"])  # its size can't be told from the few rows it comes from
        .select("s", "begin", (F.col("whole") * (hi(F.lit(block)) - lo) + F.greatest(F.lit(0), hi(F.col("part")) - lo)).alias("words"))
        .groupBy("s", "begin")
        .agg(F.sum("words").alias("taken"))
    )
    full = placed.join(by_doc, ["s", "begin"], "left").select("doc_id", "s", "text_hash", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    blank = base.where("size = 0").select("doc_id", "s", "text_hash", "size", F.lit(0).cast("long").alias("taken"))
    return full.union(blank).join(goals, "s").select(
        "doc_id", "size", "source_size", "target", "taken", F.col("s").alias("source_key"), "text_hash"
    )


def _rounded(units: DataFrame, seed: int) -> DataFrame:
    """``units`` (source_key, size, share, h, doc_id, text_hash) with the copies of each: its
    share (copies due, a fraction, times _SCALE), rounded so that the running sum of copies
    of a source never strays a whole copy from that of shares. A seeded offset a source makes
    the expected copies the share itself. The sums run from short to long texts, so the words
    of a source stray by about one long text.

    As in :func:`mix`, no window sees a whole source: sums go by size class, by hash bucket
    inside a class, and then along a bucket."""
    units = units.withColumn("class", F.floor(F.log2("size") * _CLASSES)).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)))
    sums = saved(units.groupBy("source_key", "class", "bucket").agg(F.sum("share").alias("in_bucket")), "shares")
    by_class = Window.partitionBy("source_key").orderBy("class")  # some hundred rows each
    classes = sums.groupBy("source_key", "class").agg(F.sum("in_bucket").alias("in_class"))
    classes = classes.select("source_key", "class", (F.sum("in_class").over(by_class) - F.col("in_class")).alias("shorter"))
    by_bucket = Window.partitionBy("source_key", "class").orderBy("bucket")  # at most _BUCKETS rows each
    before = sums.select(
        "source_key", "class", "bucket", (F.sum("in_bucket").over(by_bucket) - F.col("in_bucket")).alias("offset")
    ).join(classes, ["source_key", "class"])
    inside = (
        Window.partitionBy("source_key", "class", "bucket").orderBy("h", "doc_id", "text_hash")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    start = F.pmod(F.xxhash64("source_key", F.lit(seed)), F.lit(_SCALE))
    upto = start + F.col("shorter") + F.col("offset") + F.col("along")
    return units.withColumn("along", F.sum("share").over(inside)).join(before, ["source_key", "class", "bucket"]).withColumn(
        "copies", F.shiftright(upto, _SCALE_BITS) - F.shiftright(upto - F.col("share"), _SCALE_BITS)
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` in the mix, a row as many times as the mix takes its words. Rows
    are taken whole, so the copies are rounded, along each source (:func:`_rounded`): the
    words of a source are its target give or take about one long text, and texts of every
    length are taken at the source's rate. Texts without words go."""
    key = ["doc_id", "source_key", "text_hash"]
    seed = settings.get("seed", SEED)
    units = (
        mix(docs, **settings).where("size > 0")
        .groupBy(*key)  # rows that repeat whole share their takes
        .agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
        .withColumn("share", F.expr(f"taken div size * {_SCALE} + taken % size * {_SCALE} div size"))
        .withColumn("h", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash", F.lit(seed + 1)))
    )
    copies = saved(
        _rounded(saved(units, "units"), seed).where("copies > 0")
        .select(*key, F.expr("copies div rows").alias("each"), F.expr("copies % rows").alias("more")),
        "copies",
    )
    tagged = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("i"), _key(F.col("source").cast("string")).alias("k"), F.xxhash64("text").alias("h"),
    )
    same = F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("source_key")) & (F.col("h") == F.col("text_hash"))
    found = tagged.join(copies.where("more = 0"), same).select("row", F.col("each").alias("n"))
    uneven = copies.where("more > 0")
    if not uneven.isEmpty():  # among rows that repeat, some are taken once more
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json("row"))))
        spread = tagged.join(uneven, same).select("row", (F.col("each") + (nth <= F.col("more")).cast("long")).alias("n"))
        found = found.union(spread.where("n > 0"))
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
