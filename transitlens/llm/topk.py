"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query in blocks: packed candidate blocks meet packed
query blocks by a join on the query block's number. Each round turns the scores into a
histogram per query over the score range that may hold its k-th value; the counts are summed
over all blocks, and the bin that holds the k-th value becomes the next range, until a bin is
one score wide. A last round keeps every score above the k-th value and, of those equal to
it, as many as are still wanted, smaller ids first.

A block reports only bins from its own k-th value upwards. The global k-th value is never
below a block's own, so every bin that decides is complete, and a block sends at most k bins
a query whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitlens.llm import grid
from transitlens.llm.negatives import minable
from transitlens.llm.tables import reach, saved

K_BEST = 5
BINS = 512
QUERY_BLOCK = 1024  # queries packed in one row
CANDIDATE_BLOCK = 2048  # candidates packed in one row
_EXACT = 1 << 53


def quantised(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component, as long; null for a vector that is null, holds a
    null, NaN or infinite component, or whose length reaches 2**31 (so that scores always fit a
    long)."""
    return minable(vector, factor)


def _pack(rows: int):
    """Packs (id, vec) rows of one partition into blocks, one vector length each."""

    def run(batches):
        held: dict[int, list] = {}

        def block(dim: int):
            ids = np.concatenate([a for a, _ in held[dim]])
            flat = np.concatenate([v for _, v in held.pop(dim)])
            for lo in range(0, len(ids), rows):
                hi = lo + rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dim], pa.int32()),
                        pa.array([ids[lo:hi].tolist()], pa.list_(pa.int64())),
                        pa.array([flat[lo * dim : hi * dim].tobytes()], pa.binary()),
                    ],
                    ["dim", "ids", "vecs"],
                )

        for batch in batches:
            ids, vecs = batch.column(0).to_numpy(), batch.column(1)
            flat = vecs.flatten().to_numpy()
            size = np.diff(vecs.offsets.to_numpy())
            begin = np.cumsum(size) - size
            for dim in np.unique(size):
                at = np.flatnonzero(size == dim)
                part = flat[(begin[at][:, None] + np.arange(dim)).ravel()]
                held.setdefault(int(dim), []).append((ids[at], part))
                if sum(len(a) for a, _ in held[int(dim)]) >= rows:
                    yield from block(int(dim))
        for dim in list(held):
            yield from block(dim)

    return run


def _scores(queries: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """All inner products, exact: in doubles where no sum can pass 2**53, else in integers. By
    Cauchy and Schwarz the lengths bound every score, which must stay below 2**63."""
    length = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    largest = length(queries) * length(vecs) * (1 + 1e-9)
    if largest < _EXACT:
        return (queries.astype(np.float64) @ vecs.astype(np.float64).T).astype(np.int64)
    if largest >= 2.0**63:
        raise OverflowError("an inner product may not fit in 64 bits")
    return queries @ vecs.T


def _each(batches):
    """(query ids, their state, candidate ids, scores) of every pair of blocks; a query is
    never its own candidate: ``own`` marks those places."""
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            qid = np.asarray(row["qids"], dtype=np.int64)
            cid = np.asarray(row["ids"], dtype=np.int64)
            q = np.frombuffer(row["qvecs"], np.int64).reshape(len(qid), dim)
            c = np.frombuffer(row["vecs"], np.int64).reshape(len(cid), dim)
            yield row, qid, cid, _scores(q, c), qid[:, None] == cid[None, :]


def _histogram(k: int, bins: int):
    def run(batches):
        for row, qid, _, score, own in _each(batches):
            lo = np.asarray(row["lo"], dtype=np.int64)[:, None]
            width = np.asarray(row["width"], dtype=np.int64)[:, None]
            span = np.asarray(row["span"], dtype=np.int64)[:, None]
            live = ~own & (score >= lo) & (score < lo + span)
            q, _ = np.nonzero(live)
            at = ((score - lo) // width)[live]
            held = np.bincount(q * bins + at, minlength=len(qid) * bins).reshape(len(qid), bins)
            above = np.cumsum(held[:, ::-1], axis=1)[:, ::-1] - held
            q, b = np.nonzero((held > 0) & (above < k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid[q]), pa.array(b, pa.int64()), pa.array(held[q, b], pa.int64())],
                ["query_id", "bin", "held"],
            )

    return run


def _select(batches):
    for row, qid, cid, score, own in _each(batches):
        kth = np.asarray(row["lo"], dtype=np.int64)[:, None]
        need = np.asarray(row["need"], dtype=np.int64)
        over_q, over_c = np.nonzero(~own & (score > kth))
        # of the ties at the k-th value, this block's smallest ids suffice
        order = np.argsort(cid, kind="stable")
        tie = (~own & (score == kth))[:, order]
        tie &= np.cumsum(tie, axis=1) <= need[:, None]
        tie_q, tie_c = np.nonzero(tie)
        q, c = np.r_[over_q, tie_q], np.r_[over_c, order[tie_c]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(qid[q]), pa.array(cid[c]), pa.array(score[q, c])], ["query_id", "vec_id", "score"]
        )


def exact_top_k(
    vectors: DataFrame,
    query: Column,
    k: int = K_BEST,
    bins: int = BINS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The k best candidates of every query: query_id, rank (from 1), vec_id, score.

    ``vectors`` has vec_id (long) and vec (array of long); ``query`` marks the rows that are
    queries. Every row but the query's own (those with its vec_id) is a candidate. Scores are
    integer inner products, ties go to smaller ids. Rows with a null vec_id or vec take no
    part; vectors of another length than the query's are no candidates; a vec_id that
    comes up again is one more candidate, and a repeated query counts once, by its smallest
    vector. Fewer than k candidates are all returned; none give no rows.
    """
    spark = vectors.sparkSession
    reach(spark)
    fine = vectors.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    blocks = saved(
        fine.select("vec_id", "vec").mapInArrow(
            _pack(CANDIDATE_BLOCK), "dim int, ids array<long>, vecs binary"
        ),
        "candidates",
    )
    asked = fine.where(query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    # a query's bound: no score is beyond |q| * max |c|, so the first range holds them all
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    most = fine.agg(F.max(norm(F.col("vec")))).first()[0] or 0.0
    asked = saved(asked.withColumn("bound", F.ceil(norm(F.col("vec")) * most * 1.000001) + 1), "asked")
    parts = max(1, -(-asked.count() // query_block))
    cells = grid.parts(blocks)
    state = asked.select(
        F.col("vec_id").alias("query_id"),
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("qb"),
        "vec",
        (-F.col("bound")).alias("lo"),
        (2 * F.col("bound") + 1).alias("span"),
        F.ceil((2 * F.col("bound") + 1) / bins).alias("width"),
        F.lit(k).cast("long").alias("need"),
    )

    def joined(state: DataFrame) -> DataFrame:
        """Every candidate block with every query block of its vector length, in a grid: no task
        gets all the candidates of a query block."""
        packed = state.groupBy("qb", F.size("vec").alias("dim")).agg(
            F.collect_list(F.struct("query_id", "lo", "span", "width", "need", "vec")).alias("q")
        )  # about query_block queries each
        packed = packed.select(
            "qb", "dim", F.col("q.query_id").alias("qids"), F.col("q.lo").alias("lo"),
            F.col("q.span").alias("span"), F.col("q.width").alias("width"), F.col("q.need").alias("need"),
            F.flatten("q.vec").alias("flat"),
        ).mapInArrow(_flat, "qb long, dim int, qids array<long>, lo array<long>, span array<long>, width array<long>, need array<long>, qvecs binary")
        return grid.meet(blocks, packed, cells, parts)

    def refine(state: DataFrame, counts: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        total = counts.groupBy("query_id", "bin").agg(F.sum("held").alias("held"))
        upto = total.withColumn("upto", F.sum("held").over(w))
        # the last bin counts where fewer than `need` candidates exist
        found = (
            upto.join(state.select("query_id", "need"), "query_id")
            .groupBy("query_id")
            .agg(
                F.max(F.when(F.col("upto") >= F.col("need"), F.struct("bin", (F.col("upto") - F.col("held")).alias("over")))).alias("at"),
                F.min(F.struct("bin", (F.col("upto") - F.col("held")).alias("over"))).alias("last"),
            )
            .select("query_id", F.coalesce("at", "last").alias("at"))
        )
        return (
            state.join(found, "query_id")
            .select(
                "query_id", "qb", "vec",
                (F.col("lo") + F.col("at.bin") * F.col("width")).alias("lo"),
                F.col("width").alias("span"),
                F.ceil(F.col("width") / bins).alias("width"),
                (F.col("need") - F.col("at.over")).alias("need"),
                (F.col("width") == 1).alias("done"),
            )
        )

    # Every query goes through as many rounds as the widest range needs; one whose bin is one
    # score wide only repeats its last step.
    while True:
        counts = joined(state).mapInArrow(_histogram(k, bins), "query_id long, bin long, held long")
        state = saved(refine(state, counts), "ranges")
        if state.where("NOT done").isEmpty():
            break
        state = state.drop("done")
    chosen = joined(state).mapInArrow(_select, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        chosen.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _flat(batches):
    """Turns the flat vector list of a query block into bytes."""
    for batch in batches:
        flat = batch.column("flat")
        raw = [np.asarray(flat[i].values.to_numpy(), dtype=np.int64).tobytes() for i in range(len(flat))]
        cols = [batch.column(n) for n in ("qb", "dim", "qids", "lo", "span", "width", "need")]
        yield pa.RecordBatch.from_arrays(
            [*cols, pa.array(raw, pa.binary())], ["qb", "dim", "qids", "lo", "span", "width", "need", "qvecs"]
        )
