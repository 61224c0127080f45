"""Approximate nearest neighbours by cosine on robust-pruned directed graphs.

Equal vectors are one node, with the few smallest ids that a query may ask of them. Nodes are
dealt to shards of bounded size by a hash of the vector, and each shard gets a graph: nodes are
inserted in batches, greedy beam searches of the graph so far propose a node's neighbours, and
relaxed pruning keeps the nearest one and leaves out all that are ``alpha`` times closer to a kept
neighbour than to the node, so the kept edges point in different directions. Each edge is entered
backwards too; a node with too many edges is pruned again. A query walks the graph of every shard
with a beam, and the candidates in the beam are scored exactly on the original vectors.

All steps work on a batch of nodes or queries at once, with numpy. A graph is written once, to a
file of its own, and is not moved again: the queries go round in blocks of bounded size, each block
broadcast to the tasks that read the graphs, and a task keeps the best rows of a query over all its
graphs. So what is shuffled doesn't grow with graphs x queries.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitlens.llm import grid
from transitlens.llm.tables import reach, saved

K_BEST = 5
SHARD_ROWS = 8192  # nodes of a graph, about
SHARD_BYTES = 16 << 20  # of vectors of a graph, about
DEGREE = 32
BEAM = 64  # of an insertion
SEARCH_BEAM = 160  # of a query
ALPHA = 1.2
QUERY_BLOCK = 16384  # queries that go round together, about
QUERY_BYTES = 8 << 20  # of their vectors, about
TASKS = 64  # that read the graphs in a round, at most, or three for each core if these are more
_WIDTH = 4  # nodes of a beam opened at once
_SLACK = 1.3  # edges a node may gather before it is pruned again
_BATCH = 256
_SEED = 20240229


class Graph:
    """A robust-pruned graph over unit vectors (rows of ``x``, 32-bit)."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entry: int = 0, degree: int = DEGREE) -> None:
        self.x = x
        self.degree = degree
        self.entry = entry
        self.edges = np.full((len(x), int(degree * _SLACK) + 1), -1, np.int32) if edges is None else edges

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> "Graph":
        """Inserts all rows, in a fixed order that starts with the row nearest to the mean."""
        self = cls(x, degree=degree)
        if not len(x):
            return self
        self.entry = int(np.argmax(x @ x.mean(axis=0)))
        order = np.random.Generator(np.random.PCG64(_SEED)).permutation(len(x))
        order = order[order != self.entry]
        # batches grow with the graph, so that a batch's nodes, which don't see each other, are few
        lo, size = 0, 1
        while lo < len(order):
            some = order[lo : lo + size]
            found, near = self.search(x[some], beam)
            self._insert(some, self._pruned(some, found, near, alpha), alpha)
            lo += len(some)
            size = min(_BATCH, max(1, lo // 4))
        self._connect(beam)
        return self

    def _reached(self) -> np.ndarray:
        """Which nodes a walk from the entry can meet."""
        met = np.zeros(len(self.x), dtype=bool)
        front = np.array([self.entry])
        while len(front):
            met[front] = True
            around = np.unique(self.edges[front])
            around = around[around >= 0]
            front = around[~met[around]]
        return met

    def _connect(self, beam: int) -> None:
        """Pruning may cut a node off; it gets an edge from a near node that has room for one."""
        while len(lost := np.flatnonzero(~self._reached())):
            some = lost[:_BATCH]
            found, _ = self.search(self.x[some], beam)
            for node, near in zip(some.tolist(), found):
                near = near[near >= 0]
                room = near[self.edges[near, -1] < 0]
                if not len(room):
                    self.edges = np.concatenate([self.edges, np.full((len(self.x), 1), -1, np.int32)], axis=1)
                    room = near
                held = self.edges[room[0]]
                held[np.argmax(held < 0)] = node

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the best ``beam`` nodes that a greedy walk meets, best first;
        -1 and -inf where it meets fewer."""
        parts = [self._search(queries[lo : lo + _BATCH], beam) for lo in range(0, len(queries), _BATCH)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros((0, beam), np.int32), np.zeros((0, beam), np.float32))

    def _search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        x, n = self.x, len(self.x)
        rows = len(queries)
        at = np.full((rows, beam), -1, np.int32)
        near = np.full((rows, beam), -np.inf, np.float32)
        opened = np.zeros((rows, beam), dtype=bool)
        unseen = np.ones(rows * n, dtype=bool)
        at[:, 0] = self.entry
        near[:, 0] = queries @ x[self.entry]
        base = np.arange(rows) * n
        unseen[base + self.entry] = False
        while True:
            closed = (at >= 0) & ~opened
            some = np.flatnonzero(closed.any(axis=1))
            if not len(some):
                return at, near
            closed = closed[some]
            # the first few nodes of each beam that are not opened yet
            chosen = closed & (np.cumsum(closed, axis=1) <= _WIDTH)
            r, c = np.nonzero(chosen)
            opened[some[r], c] = True
            around = self.edges[at[some[r], c]]
            flat = base[some[r]][:, None] + around
            flat = flat[around >= 0]
            flat = np.sort(flat[unseen.take(flat)])
            flat = flat[np.diff(flat, prepend=-1) > 0]
            unseen[flat] = False
            q = np.repeat(np.arange(rows), np.diff(np.searchsorted(flat, np.r_[base, rows * n])))
            node = (flat - base[q]).astype(np.int32)
            sim = np.einsum("ij,ij->i", queries.take(q, axis=0), x.take(node, axis=0))
            # the others would be cut off below: of equals, those in the beam stay
            better = sim > near[q, -1]
            if not better.any():
                continue
            q, node, sim = q[better], node[better], sim[better]
            first = np.searchsorted(q, some)
            slot = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            wide = int(slot.max()) + 1
            row = np.searchsorted(some, q)
            new_at = np.full((len(some), wide), -1, np.int32)
            new_near = np.full((len(some), wide), -np.inf, np.float32)
            new_at[row, slot], new_near[row, slot] = node, sim
            all_near = np.concatenate([near[some], new_near], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[some] = np.take_along_axis(all_near, order, axis=1)
            at[some] = np.take_along_axis(np.concatenate([at[some], new_at], axis=1), order, axis=1)
            was = np.concatenate([opened[some], np.zeros((len(some), wide), dtype=bool)], axis=1)
            opened[some] = np.take_along_axis(was, order, axis=1)

    def _pruned(self, nodes: np.ndarray, some: np.ndarray, near: np.ndarray, alpha: float) -> np.ndarray:
        """Up to ``degree`` neighbours of every node out of its candidates ``some`` (-1: none,
        no repeats), by similarity ``near``."""
        out = np.full((len(nodes), self.degree), -1, np.int32)
        step = max(1, (1 << 21) // max(1, some.shape[1] ** 2))
        for lo in range(0, len(nodes), step):
            cut = slice(lo, lo + step)
            order = np.argsort(-near[cut], axis=1, kind="stable")
            cand = np.take_along_axis(some[cut], order, axis=1)
            # squared distances of unit vectors; alpha counts on distances
            away = 2 - 2 * np.take_along_axis(near[cut], order, axis=1)
            alive = (cand >= 0) & (cand != nodes[cut][:, None])
            vecs = self.x[np.maximum(cand, 0)]
            apart = np.maximum(2 - 2 * (vecs @ vecs.transpose(0, 2, 1)), 0) * np.float32(alpha * alpha)
            every = np.arange(len(cand))
            for j in range(self.degree):
                best = alive.argmax(axis=1)
                has = alive[every, best]
                if not has.any():
                    break
                out[lo + every[has], j] = cand[every[has], best[has]]
                alive &= apart[every, best] > away
                alive[every, best] = False
        return out

    def _insert(self, nodes: np.ndarray, kept: np.ndarray, alpha: float) -> None:
        edges = self.edges
        edges[nodes, : self.degree] = kept
        r, c = np.nonzero(kept >= 0)
        to, back = kept[r, c], nodes[r].astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(first, count)
        held = (edges[ends] >= 0).sum(axis=1)
        fits = held + count <= edges.shape[1]
        whose = np.repeat(np.arange(len(ends)), count)
        easy = fits[whose]
        edges[to[easy], (held[whose] + slot)[easy]] = back[easy]
        full = np.flatnonzero(~fits)
        if not len(full):
            return
        wide = edges.shape[1] + int(count[full].max())
        some = np.full((len(full), wide), -1, np.int32)
        some[:, : edges.shape[1]] = edges[ends[full]]
        row = np.full(len(ends), -1)
        row[full] = np.arange(len(full))
        hard = ~easy
        some[row[whose[hard]], edges.shape[1] + slot[hard]] = back[hard]
        near = np.where(some >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(some, 0)], self.x[ends[full]]), -np.inf)
        edges[ends[full]] = -1
        edges[ends[full], : self.degree] = self._pruned(ends[full], some, near.astype(np.float32), alpha)


def scaled(vecs: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    most = np.abs(vecs).max(axis=1, initial=0)
    return np.ldexp(vecs, -np.frexp(most)[1][:, None])


def cosine(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` and the same row of ``c``, both :func:`scaled`; equal rows
    give equal values wherever they stand."""
    return (a * c).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def _unit(vecs: np.ndarray) -> np.ndarray:
    return (vecs / np.sqrt((vecs * vecs).sum(axis=1))[:, None]).astype(np.float32)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _packed(vecs: np.ndarray) -> bytes:
    """The bytes of a matrix, as 32-bit numbers where that loses nothing."""
    small = vecs.astype(np.float32)
    return (small if np.array_equal(small, vecs) else vecs).tobytes()


def _unpacked(held: pa.BinaryScalar, rows: int, dim: int) -> np.ndarray:
    buffer = held.as_buffer()
    kind = np.float32 if buffer.size == 4 * rows * dim else np.float64
    return np.frombuffer(buffer, kind).reshape(rows, dim).astype(np.float64)


_INDEX = pa.schema(
    [("shard", pa.int64()), ("dim", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
     ("vecs", pa.binary()), ("edges", pa.binary()), ("entry", pa.int32())]
)
_INDEX_SQL = "shard long, dim int, ids array<long>, counts array<int>, vecs binary, edges binary, entry int"


def _built(degree: int, beam: int, alpha: float):
    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("first", "ascending")])  # the same graph whatever the order of arrival
        dim = rows["dim"][0].as_py()
        vecs = scaled(_matrix(rows["vec"], dim))
        graph = Graph.build(_unit(vecs), degree, beam, alpha)
        ids = rows["ids"].combine_chunks()
        return pa.Table.from_pylist(
            [
                {
                    "shard": rows["shard"][0].as_py(),
                    "dim": dim,
                    "ids": ids.flatten().to_pylist(),
                    "counts": np.diff(ids.offsets.to_numpy()).tolist(),
                    "vecs": _packed(vecs),
                    "edges": graph.edges.tobytes(),
                    "entry": graph.entry,
                }
            ],
            _INDEX,
        )

    return build


def _asked(batches):
    """Packs the vectors of a block of queries."""
    for batch in batches:
        for row in batch.to_pylist():
            vecs = np.asarray([x["vec"] for x in row["q"]], dtype=np.float64).reshape(len(row["q"]), row["dim"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["qb"]], pa.int64()), pa.array([row["dim"]], pa.int32()),
                 pa.array([[x["vec_id"] for x in row["q"]]], pa.list_(pa.int64())), pa.array([_packed(scaled(vecs))], pa.binary())],
                ["qb", "dim", "qids", "qvecs"],
            )


def _best(r: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best rows of every query ``r``; ties go to smaller ids."""
    order = np.lexsort((vec_id, -score, r))
    r, vec_id, score = r[order], vec_id[order], score[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[best], vec_id[best], score[best]


def _searched(k: int, beam: int, degree: int):
    """A ``mapInArrow`` function: the ``k`` best rows of every query over all graphs of a partition.
    A row has a graph and a block of queries; a block's number and vector length are its key."""

    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                dim = row["dim"].as_py()
                qid = row["qids"].values.to_numpy()
                ids, count = row["ids"].values.to_numpy(), row["counts"].values.to_numpy()
                first = np.cumsum(count) - count
                q, vecs = _unpacked(row["qvecs"], len(qid), dim), _unpacked(row["vecs"], len(count), dim)
                edges = np.frombuffer(row["edges"].as_buffer(), np.int32).reshape(len(count), -1)
                graph = Graph(_unit(vecs), edges, row["entry"].as_py(), degree)
                key = row["qb"].as_py(), dim
                parts = [held[key][1:]] if key in held else []
                for lo in range(0, len(qid), _BATCH):
                    own, some = qid[lo : lo + _BATCH], q[lo : lo + _BATCH]
                    at, _ = graph.search(_unit(some), beam)
                    r, c = np.nonzero(at >= 0)
                    node = at[r, c]
                    score = cosine(some[r], vecs[node])
                    # every id of a node is a candidate, but for the query's own
                    many = count[node]
                    r, score, begin = np.repeat(r, many), np.repeat(score, many), np.repeat(first[node], many)
                    vec_id = ids[begin + np.arange(len(begin)) - np.repeat(np.cumsum(many) - many, many)]
                    other = vec_id != own[r]
                    r, vec_id, score = _best(r[other], vec_id[other], score[other], k)
                    parts.append((lo + r, vec_id, score))
                held[key] = np.array(qid), *_best(*(np.concatenate(x) for x in zip(*parts)), k)
        for qid, r, vec_id, score in held.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(qid[r]), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"]
            )

    return run


def usable(vector: Column) -> Column:
    """The vector as doubles; null where it is null, zero or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    return F.when(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), vector.cast("array<double>"))


def index(
    vectors: DataFrame, per_class: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA
) -> tuple[DataFrame, int]:
    """(one row for each shard: its nodes' ids and vectors and its graph; number of shards).

    Equal vectors are one node that carries its ``per_class`` smallest ids."""
    place = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_class)
    nodes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = saved(nodes.withColumn("dim", F.size("vec")), "nodes")
    n, dim = nodes.agg(F.count("*"), F.max("dim")).first()
    rows = min(shard_rows, max(1, SHARD_BYTES // (8 * (dim or 1))))
    shards = max(1, -(-n // rows))
    dealt = nodes.select(
        F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("shard"), "dim", "vec", "ids", F.get("ids", F.lit(0)).alias("first")
    )
    # one or a few graphs a task, whatever the rows weigh: building takes long
    dealt = dealt.repartition(min(2 * shards, 4096), "shard", "dim")
    built = dealt.groupBy("shard", "dim").applyInArrow(_built(degree, beam, alpha), _INDEX_SQL)
    return saved(built, "graphs", per_file=1), shards


def met(graphs: DataFrame, block: DataFrame, tasks: int, k: int, beam: int, degree: int = DEGREE) -> DataFrame:
    """query_id, vec_id, score: for each of ``tasks`` tasks at most, the ``k`` best rows that its
    graphs find for every query of a block. The block is broadcast, the graphs stay where they are."""
    return graphs.coalesce(tasks).join(F.broadcast(block), "dim").mapInArrow(
        _searched(k, beam, degree), "query_id long, vec_id long, score double"
    )


def nearest(
    vectors: DataFrame,
    query: Column,
    k: int = K_BEST,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BEAM,
    search_beam: int = SEARCH_BEAM,
    alpha: float = ALPHA,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows that the graphs find.

    ``vectors`` has vec_id (long) and vec (array of double, see :func:`usable`); ``query`` marks
    the rows that are queries. Every row but those with the query's vec_id is a candidate, all
    rows are indexed. ``score`` is the cosine in double precision; best first, ties go to smaller
    ids. Rows with a null vec_id or vec take no part; vectors of another length than the query's
    are no candidates; a vec_id that comes up again is one more candidate where its vector
    differs, and a repeated query counts once, by its smallest vector. Every node can be reached
    from its graph's entry, so a shard of no more than ``search_beam`` nodes is searched whole.
    """
    spark = vectors.sparkSession
    reach(spark)
    if search_beam <= k:
        raise ValueError("the beam must hold more than k nodes")
    fine = vectors.where("vec_id IS NOT NULL AND vec IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "vec")
    asked = saved(fine.where(query).groupBy("vec_id").agg(F.min("vec").alias("vec")), "asked")
    # a query skips its own id alone, so k + 1 ids of equal vectors are all it may need
    graphs, shards = index(fine.distinct(), k + 1, shard_rows, degree, beam, alpha)
    n, dim = asked.agg(F.count("*"), F.max(F.size("vec"))).first()
    cores = 3 * spark.sparkContext.defaultParallelism
    # where graphs are few, several smaller blocks go round at once, so that all cores have work
    at_once = max(1, cores // shards)
    most = min(query_block, QUERY_BYTES // (8 * (dim or 1))) // at_once
    n_blocks, qb = grid.block_number(n, F.col("vec_id"), max(1, min(most, max(_BATCH, -(-n // at_once)))))
    blocks = saved(
        asked.groupBy(qb.alias("qb"), F.size("vec").alias("dim"))
        .agg(F.collect_list(F.struct("vec_id", "vec")).alias("q"))  # about query_block queries
        .mapInArrow(_asked, "qb long, dim int, qids array<long>, qvecs binary"),
        "blocks",
        per_file=1,
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rounds = []
    for lo in range(0, n_blocks, at_once):
        some = [blocks.where(F.col("qb") == i) for i in range(lo, min(n_blocks, lo + at_once))]
        found = reduce(DataFrame.unionAll, [met(graphs, x, max(TASKS, cores), k, search_beam, degree) for x in some])
        best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        # one round after the other: memory holds the blocks of one
        rounds.append(saved(best.select("query_id", "rank", "vec_id", "score"), "found"))
    return reduce(DataFrame.unionAll, rounds)
