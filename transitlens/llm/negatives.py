"""Hard-negative mining with segment summary filtering.

Every vector is cut into segments of equal length, on several levels, each cutting the segments
of the level before; of each segment its mean and its deviation are stored. For two vectors the
sum over segments of n * mean * mean' is their inner product but for the deviations from the
means, which by Cauchy and Schwarz add or take n * deviation * deviation' at most. So each level
bounds every score from both sides, and pairs that can't matter are left out level by level; only
the rest is scored exactly.

A first pass finds each anchor's positives: a pair goes where its upper bound is under the k-th
best lower bound, or under the k-th best score that the task has seen. A second pass finds the
negatives of each (anchor, positive): scores between two shares of the positive's score. A pair
goes where its bounds miss every such interval, or where enough others are certain to lie in the
interval and above it. Blocks of anchors meet blocks of candidates in a grid (:mod:`grid`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitlens.llm import grid
from transitlens.llm.tables import reach, saved

POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # percent of the positive's score
LEVELS = (1, 4, 16)  # segments of a vector
TILE = 512  # anchors compared with a candidate block at once
_LOW = np.iinfo(np.int64).min
_EXACT = float(1 << 53)


def _cuts(dim: int, segments: int) -> np.ndarray:
    return np.arange(min(segments, dim) + 1) * dim // max(1, min(segments, dim))


def summaries(vecs: np.ndarray, levels=LEVELS) -> dict[str, bytes]:
    """The vectors as 32-bit integers, and mean and deviation of every segment of every level."""
    out: dict[str, bytes] = {"vecs": vecs.astype(np.int32).tobytes()}
    n, dim = vecs.shape
    means, devs = [], []
    for segments in levels if dim else ():
        cuts = _cuts(dim, segments)
        size = np.diff(cuts)
        mean = np.add.reduceat(vecs, cuts[:-1], axis=1) / size
        off = vecs - np.repeat(mean, size, axis=1)
        means.append(mean)
        devs.append(np.sqrt(np.add.reduceat(off * off, cuts[:-1], axis=1) / size))
    # rounding to 32 bits is covered by the bounds' margin
    for name, some in (("means", means), ("devs", devs)):
        out[name] = np.concatenate(some, axis=1).astype(np.float32).tobytes() if some else b""
    return out


_SCHEMA = "dim int, ids array<long>, tags array<long>, vecs binary, means binary, devs binary"


class Side:
    """A block as arrays; ``at`` picks some of its rows."""

    def __init__(self, dim: int, vecs: bytes, means: bytes, devs: bytes, rows: int, levels) -> None:
        self.vecs = np.frombuffer(vecs, np.int32).reshape(rows, dim).astype(np.float64)
        self.cuts = [_cuts(dim, s) for s in levels] if dim else []
        wide = sum(len(c) - 1 for c in self.cuts)
        self.means = np.frombuffer(means, np.float32).reshape(rows, wide)
        self.devs = np.frombuffer(devs, np.float32).reshape(rows, wide)
        self.norm = np.sqrt((self.vecs * self.vecs).sum(axis=1))

    def at(self, rows: slice) -> "Side":
        out = object.__new__(Side)
        out.cuts = self.cuts
        for name in ("vecs", "means", "devs", "norm"):
            setattr(out, name, getattr(self, name)[rows])
        return out


def bounds(a: Side, c: Side, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all inner products on one level."""
    lo = sum(len(x) - 1 for x in a.cuts[:level])
    size = np.diff(a.cuts[level]).astype(np.float32)
    some = slice(lo, lo + len(size))
    middle = (a.means[:, some] * size) @ c.means[:, some].T
    spread = (a.devs[:, some] * size) @ c.devs[:, some].T
    # 32-bit rounding of the summaries and of the sums: far below 1e-5 of |a| |c|
    spread += a.norm[:, None].astype(np.float32) * (c.norm * 1e-5)[None, :].astype(np.float32) + np.float32(1)
    return middle - spread, middle + spread


def scored(a: Side, c: Side, live: np.ndarray) -> np.ndarray:
    """Exact inner products where ``live``, else the least integer."""
    out = np.full(live.shape, _LOW)
    rows, cols = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
    if not len(rows):
        return out
    x, y = a.vecs[rows], c.vecs[cols]
    if float(a.norm[rows].max()) * float(c.norm[cols].max()) < _EXACT:
        part = (x @ y.T).astype(np.int64)
    else:  # below 2**62, see minable()
        part = x.astype(np.int64) @ y.astype(np.int64).T
    out[np.ix_(rows, cols)] = part
    out[~live] = _LOW
    return out


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of every row; the least one where a row is shorter."""
    if values.shape[1] < k:
        low = -np.inf if values.dtype.kind == "f" else _LOW
        return np.full(len(values), low, dtype=values.dtype)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of every row but least integers; ties go to early columns."""
    kth = _kth(score, k)[:, None]
    over = score > kth
    tie = (score == kth) & (score > _LOW)
    tie &= np.cumsum(tie, axis=1) <= (k - over.sum(axis=1))[:, None]
    return np.nonzero(over | tie)


def _cells(batches, levels):
    """(query block's number, anchor ids, its row, tile, anchors, candidate ids, candidates,
    same label, own) of every tile of every pair of blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
            ids, tags = np.asarray(row["ids"], np.int64), np.asarray(row["tags"], np.int64)
            aids, atags = np.asarray(row["aids"], np.int64), np.asarray(row["atags"], np.int64)
            c = Side(row["dim"], row["vecs"], row["means"], row["devs"], len(ids), levels)
            a = Side(row["dim"], row["avecs"], row["ameans"], row["adevs"], len(aids), levels)
            for lo in range(0, len(aids), TILE):
                some = slice(lo, lo + TILE)
                same = atags[some][:, None] == tags[None, :]
                own = aids[some][:, None] == ids[None, :]
                yield row, aids[some], some, a.at(some), ids, c, same, own


def _positives(k: int, levels):
    def run(batches):
        seen: dict[tuple, np.ndarray] = {}  # the k best scores so far, of the anchors of a block
        for row, aid, tile, a, ids, c, same, own in _cells(batches, levels):
            best = seen.setdefault((row["qb"], row["dim"], tile.start), np.full((len(aid), k), _LOW))
            live = same & ~own
            least = best.min(axis=1)
            for level in range(len(a.cuts)):
                low, up = bounds(a, c, level)
                kth = _kth(np.where(live, low, -np.inf), k)
                live &= (up >= kth[:, None]) & (up >= least[:, None])
            score = scored(a, c, live)
            q, x = _best(np.where(score >= least[:, None], score, _LOW), k)
            found = score[q, x]
            # one row's finds, at most k, join the best so far
            slot = np.arange(len(q)) - np.searchsorted(q, q)
            new = np.full((len(aid), k), _LOW)
            new[q, slot] = found
            best[:] = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, -k:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(aid[q]), pa.array(ids[x]), pa.array(found)], ["anchor_id", "vec_id", "score"]
            )

    return run


def _negatives(k: int, levels):
    def run(batches):
        for row, aid, tile, a, ids, c, same, own in _cells(batches, levels):
            begin = np.asarray(row["begin"], np.int64).reshape(-1, row["wide"])[tile]
            stop = np.asarray(row["stop"], np.int64).reshape(-1, row["wide"])[tile]
            live = ~same & ~own
            for level in range(len(a.cuts)):
                low, up = bounds(a, c, level)
                wanted = np.zeros_like(live)
                for j in range(begin.shape[1]):
                    lo, hi = begin[:, j, None], stop[:, j, None]
                    sure = live & (low >= lo) & (up <= hi)
                    kth = _kth(np.where(sure, low, -np.inf), k)[:, None]
                    wanted |= (up >= lo) & (up >= kth) & (low <= hi)
                live &= wanted
            score = scored(a, c, live)
            for j in range(begin.shape[1]):
                lo, hi = begin[:, j, None], stop[:, j, None]
                q, x = _best(np.where((score >= lo) & (score <= hi), score, _LOW), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(aid[q]), pa.array(np.full(len(q), j, np.int64)), pa.array(ids[x]), pa.array(score[q, x])],
                    ["anchor_id", "at", "negative_id", "negative_score"],
                )

    return run


def minable(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, as long; null for a vector that is null, holds a
    null, NaN or infinite component, or whose length reaches 2**31, so that inner products
    always fit a long."""
    wide = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))
    square = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x)
    fine = F.forall(vector, lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    return F.when(vector.isNotNull() & fine & (square < 2.0**62), F.transform(wide, lambda x: x.cast("long")))


def _flat(batches):
    """Packs the anchors of a block, sorted by id, with their segment summaries."""
    for batch in batches:
        for row in batch.to_pylist():
            q = sorted(row["q"], key=lambda x: x["vec_id"])
            vecs = np.asarray([x["vec"] for x in q], dtype=np.int64).reshape(len(q), row["dim"])
            made = summaries(vecs, row["levels"])
            out = {"qb": row["qb"], "dim": row["dim"], "aids": [x["vec_id"] for x in q], "atags": [x["label"] for x in q]}
            out |= {f"a{n}": v for n, v in made.items()}
            out["wide"] = max(len(x["scores"]) for x in q)
            # least * p <= 100 * n <= most * p with whole n; a missing positive's holds nothing
            ranges = [
                (-(-row["least"] * p // 100), row["most"] * p // 100) if p is not None else (1, 0)
                for x in q
                for p in [*x["scores"], *[None] * (out["wide"] - len(x["scores"]))]
            ]
            out["begin"], out["stop"] = [x for x, _ in ranges], [x for _, x in ranges]
            yield pa.RecordBatch.from_pylist([out], _FLAT)


_FLAT = pa.schema(
    [("qb", pa.int64()), ("dim", pa.int32()), ("aids", pa.list_(pa.int64())), ("atags", pa.list_(pa.int64())),
     ("avecs", pa.binary()), ("ameans", pa.binary()), ("adevs", pa.binary()), ("wide", pa.int32()),
     ("begin", pa.list_(pa.int64())), ("stop", pa.list_(pa.int64()))]
)
_FLAT_SQL = (
    "qb long, dim int, aids array<long>, atags array<long>, avecs binary, ameans binary, adevs binary, "
    "wide int, begin array<long>, stop array<long>"
)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    levels: tuple[int, ...] = LEVELS,
    query_block: int = grid.QUERY_BLOCK,
    candidate_block: int = grid.CANDIDATE_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id (long), label and vec (array of long, see :func:`minable`);
    ``anchor`` marks the anchors. An anchor's positives are the ``positives`` best other rows of
    its label; for each, the ``negatives`` best rows of other labels whose score is from
    ``least`` to ``most`` percent of the positive's score come back. Scores are inner products;
    ties go to smaller ids. Rows with a null vec_id, label or vec take no part, nor do vectors
    of another length than the anchor's. A vec_id that comes up again is one more candidate; a
    repeated anchor counts once, by its smallest vector. An anchor without positives, or a
    positive without such negatives (a negative score has none), gives no rows.
    """
    spark = vectors.sparkSession
    reach(spark)
    levels = tuple(levels)
    fine = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").withColumn(
        "label", F.col("label").cast("long")
    )
    blocks = saved(
        fine.select(F.col("vec_id").cast("long"), "label", "vec").mapInArrow(
            grid.pack(candidate_block, lambda ids, tags, vecs: summaries(vecs, levels)), _SCHEMA
        ),
        "segments",
    )
    first = fine.where(anchor).groupBy("vec_id").agg(F.min(F.struct("vec", "label")).alias("v"))
    asked = saved(first.select(F.col("vec_id").cast("long").alias("vec_id"), "v.label", "v.vec"), "anchors")
    n_parts = grid.parts(blocks)
    n_blocks, qb = grid.block_number(asked.count(), F.col("vec_id"), query_block)

    def joined(state: DataFrame) -> DataFrame:
        rows = state.groupBy(qb.alias("qb"), F.size("vec").alias("dim")).agg(
            F.collect_list(F.struct("vec_id", "label", "vec", "scores")).alias("q")
        )  # about query_block anchors each
        settings = {"levels": F.array(*[F.lit(x) for x in levels]), "least": F.lit(least), "most": F.lit(most)}
        return grid.meet(blocks, rows.withColumns(settings).mapInArrow(_flat, _FLAT_SQL), n_parts, n_blocks)

    near = joined(asked.withColumn("scores", F.array().cast("array<long>"))).mapInArrow(
        _positives(positives, levels), "anchor_id long, vec_id long, score long"
    )
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
    near = saved(near, "positives")
    scores = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores")
    )
    state = asked.join(scores, "vec_id")
    found = joined(state).mapInArrow(
        _negatives(negatives, levels), "anchor_id long, at long, negative_id long, negative_score long"
    )
    rank = Window.partitionBy("anchor_id", "at").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= negatives)
    some = near.select(
        "anchor_id", (F.col("place") - 1).cast("long").alias("at"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return found.join(some, ["anchor_id", "at"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
