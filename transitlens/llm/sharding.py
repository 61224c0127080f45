"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many points of a hash ring; a point's place follows from the shard's number
and the point's, so a further shard only adds points. A key starts at the next point clockwise;
where that shard is full it continues to the next other shard clockwise, and so on. So without
bounds one more shard takes keys only into itself, and with them only keys of full shards move
besides.

A shard is full at its bound. On a key's first lap that is the mean load and a small slack; from
then on an extra is added that doubles every second round, but stops at the bytes of the largest
key. Some shard always holds no more than the mean, so with that extra every key fits somewhere,
and no load ever passes the mean, the slack and the largest key.

The walk is run for all keys at once, one step a round. In a round, each shard admits the keys
that arrive in a fixed order (larger first, then by hash) as far as its bound allows. Only a
histogram of arriving bytes by (shard, place in the order) is summed, and the round's outcome
is one limit for each shard; so a row's shard follows from its own values and a few hundred
numbers, and nothing is sorted or gathered. Each lap tells places finer than the one before, so
that in the end a place holds a single key. Keys that were not admitted are written now and then,
and later rounds read only those.

Equal texts are one key. A key of more than 1/24 of a shard is split by doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from transitlens.llm import kernels as K
from transitlens.llm.tables import reach, saved

SHARDS = 24
POINTS = 128  # of each shard on the ring
SLACK = 0.0005
_SPLIT = 24
_CLASSES = 512  # of sizes, in the order of admission
_BITS = (8, 20, 34, 48)  # hash bits that tell places within a class, by lap
_CELLS = 256  # row-number cells of a shard


def ring(shards: int = SHARDS, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted points, walk): ``walk[i]`` lists all shards clockwise from point i."""
    shard = np.repeat(np.arange(1, shards + 1, dtype=np.uint64), points)
    point = np.tile(np.arange(1, points + 1, dtype=np.uint64), shards)
    with np.errstate(over="ignore"):
        at = K.mix(K.mix(shard * np.uint64(0x9E3779B97F4A7C15)) + point)
    order = np.lexsort((shard, at))
    owner = np.repeat(np.arange(shards), points)[order]
    walk = np.zeros((len(owner), shards), dtype=np.int16)
    twice = np.r_[owner, owner]
    for i in range(len(owner)):
        _, first = np.unique(twice[i : i + len(owner)], return_index=True)
        walk[i] = twice[i + np.sort(first)]
    return at[order], walk


def _order(size: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    """Place in the order of admission: larger rows first, then by hash."""
    large = np.minimum(8 * np.log2(size.astype(np.float64)), _CLASSES - 1).astype(np.int64)
    low = (key >> np.uint64(8)) & np.uint64((1 << bits) - 1)
    return ((_CLASSES - 1 - large) << bits) + low.astype(np.int64)


class Walk:
    """The rounds so far: ``limits[r][shard]`` is the first place in the order that round r
    does not admit."""

    def __init__(self, shards: int) -> None:
        self.shards = shards
        self.points, self.walk = ring(shards)
        self.limits: list[np.ndarray] = []

    def bits(self, r: int) -> int:
        return _BITS[min(r // self.shards, len(_BITS) - 1)]

    def place(self, key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, or the shard a key asks next; whether it is admitted)."""
        key = key.astype(np.int64).view(np.uint64)
        start = np.searchsorted(self.points, key) % len(self.points)
        shard = np.full(len(key), -1, dtype=np.int64)
        left = np.arange(len(key))
        for r, limit in enumerate(self.limits):
            if not len(left):
                break
            at = self.walk[start[left], r % self.shards]
            fits = _order(size[left], key[left], self.bits(r)) < limit[at]
            shard[left[fits]] = at[fits]
            left = left[~fits]
        done = shard >= 0
        shard[left] = self.walk[start[left], len(self.limits) % self.shards]
        return shard, done


def _arriving(walk: Walk):
    """Bytes that ask for a shard in this round, by place in the order."""

    def run(batches):
        for batch in batches:
            key, size, held = (batch.column(i).to_numpy() for i in range(3))
            shard, done = walk.place(key, size)
            rank = _order(size, key.view(np.uint64), walk.bits(len(walk.limits)))
            shard, rank, held = shard[~done], rank[~done], held[~done]
            order = np.lexsort((rank, shard))
            shard, rank, held = shard[order], rank[order], held[order]
            first = np.flatnonzero(np.r_[len(shard) > 0, (np.diff(shard) != 0) | (np.diff(rank) != 0)][: len(shard)])
            total = np.add.reduceat(held, first) if len(first) else held
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard[first]), pa.array(rank[first]), pa.array(total)], ["shard", "rank", "bytes"]
            )

    return run


def _waiting(walk: Walk):
    """The keys that no round has admitted."""

    def run(batches):
        for batch in batches:
            _, done = walk.place(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield batch.filter(pa.array(~done))

    return run


def with_keys(docs: DataFrame) -> DataFrame:
    """The other columns, and _size, _crc, _text (hash of the text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        *[c for c in docs.columns if c != "text"],
        (F.octet_length(text) + 8).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_text"),
    )


def plan(keyed: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> tuple[Walk, DataFrame]:
    """(the walk with all its limits, the split keys). ``keyed`` has doc_id, _size, _text."""
    walk = Walk(shards)
    groups = keyed.groupBy("_text").agg(F.sum("_size").alias("bytes"))
    total = keyed.agg(F.sum("_size")).first()[0] or 0
    share = max(1, total // shards // _SPLIT)
    # their bytes sum to the total at most: no more than shards * _SPLIT rows, and one more
    split = saved(
        groups.where(F.col("bytes") > share).select("_text", F.ceil(F.col("bytes") / share).alias("_parts")), "split"
    )
    keys = ring_keys(keyed, split).groupBy("_key", "_size").agg(F.sum("_size").alias("_bytes"))
    rows = saved(keys, "keys")
    largest = rows.agg(F.max("_bytes")).first()[0] or 0
    load = np.zeros(shards)
    while True:
        bound = total / shards * (1 + slack) + extra_room(len(walk.limits), shards, total / shards * slack, largest)
        w = Window.partitionBy("shard").orderBy("rank")
        room = F.element_at(F.array(*[F.lit(float(bound - x)) for x in load]), (F.col("shard") + 1).cast("int"))
        arriving = rows.mapInArrow(_arriving(walk), "shard long, rank long, bytes long")
        summed = arriving.groupBy("shard", "rank").agg(F.sum("bytes").alias("bytes"))
        upto = summed.withColumn("upto", F.sum("bytes").over(w)).withColumn("fits", F.col("upto") <= room)
        found = upto.groupBy("shard").agg(
            F.min(F.when(~F.col("fits"), F.col("rank"))).alias("limit"),
            F.coalesce(F.max(F.when(F.col("fits"), F.col("upto"))), F.lit(0)).alias("taken"),
        ).collect()  # one row a shard
        if not found:
            return walk, split
        limit = np.full(shards, np.iinfo(np.int64).max)
        for shard, end, taken in found:
            limit[shard] = limit[shard] if end is None else end
            load[shard] += taken
        walk.limits.append(limit)
        if len(walk.limits) & (len(walk.limits) - 1) == 0:  # after rounds 1, 2, 4, 8, ...
            rows = saved(rows.mapInArrow(_waiting(walk), "_key long, _size long, _bytes long"), "waiting")


def extra_room(r: int, shards: int, least: float, largest: int) -> float:
    """What round ``r`` adds to the bound: nothing on the first lap, then ``least``, doubled every
    second round, up to the bytes of the largest key."""
    late = r - shards
    return 0.0 if late < 0 else float(min(largest, max(1.0, least) * 2.0 ** min(late // 2, 60)))


def ring_keys(keyed: DataFrame, split: DataFrame) -> DataFrame:
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "_crc"), F.col("_parts")))
    return keyed.join(F.broadcast(split), "_text", "left").withColumn("_key", F.xxhash64("_text", part)).drop("_parts")


def shard_of(walk: Walk) -> Column:
    @pandas_udf("int")
    def place(key, size):
        import pandas as pd

        return pd.Series(walk.place(key.to_numpy(), size.to_numpy())[0].astype(np.int32))

    return place(F.col("_key"), F.col("_size"))


def numbered(placed: DataFrame) -> DataFrame:
    """Adds slot: a gapless number from 0 within each shard. Cells of a shard are numbered on
    their own and set off by the rows of the cells before."""
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "_crc", F.lit(1)), F.lit(_CELLS)))
    counts = placed.groupBy("shard", "_cell").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("shard").orderBy("_cell")
    offsets = counts.select("shard", "_cell", (F.sum("rows").over(w) - F.col("rows")).alias("_offset"))
    inside = Window.partitionBy("shard", "_cell").orderBy("doc_id", "_crc", "_size")
    return (
        placed.join(F.broadcast(offsets), ["shard", "_cell"])  # shards * _CELLS rows
        .withColumn("slot", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_cell", "_offset")
    )


def assign(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, law ('bytes'), shard, slot
    (gapless from 0 in each shard), grown_shard (null: the law is of sizes, not of keys).

    Null texts count as empty. Equal texts share a shard unless they are more than 1/24 of
    one. Rows that share a doc_id each get a slot; a null doc_id is a value like others.
    Other columns are ignored; an empty table gives no rows. No load passes the mean times
    1 + ``slack`` and the bytes of the largest key (a text's copies, at most 1/24 of a shard
    about, or one longer row); most shards end below the mean and ``slack`` alone.
    """
    reach(docs.sparkSession)
    keyed = saved(with_keys(docs.select("doc_id", "text")), "keyed")
    walk, split = plan(keyed, shards, slack)
    placed = saved(ring_keys(keyed, split).withColumn("shard", shard_of(walk)), "shards")
    return numbered(placed).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK) -> DataFrame:
    """The rows of ``docs`` with their shard and slot (columns of these names are replaced)."""
    reach(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    keyed = with_keys(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "text"))
    walk, split = plan(keyed.drop("row"), shards, slack)
    placed = ring_keys(keyed, split).withColumn("shard", shard_of(walk))
    return numbered(placed).select("row.*", "shard", F.col("slot").cast("long").alias("slot"))
