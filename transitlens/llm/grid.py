"""Vectors packed in blocks, and the grid in which a table of queries meets a table of candidates.

Query blocks are dealt by a hash of the id, candidate blocks are filled as rows come. Every
candidate block is sent to each query block's row of cells, every query block to each part of
the candidates, so one cell holds one query block and about ``PART`` candidate blocks, however
many of either there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

QUERY_BLOCK = 4096  # queries of a block, about
CANDIDATE_BLOCK = 2048  # candidates of a block, at most
PART = 16  # candidate blocks of a cell, about


def pack(rows: int, block: Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, bytes]]):
    """A ``mapInArrow`` function that packs (id, tag, vector) rows of a partition into blocks of
    at most ``rows`` vectors of one length: dim, ids, tags, and the bytes that ``block`` makes of
    (ids, tags, vectors as a matrix). Rows of a block are sorted by id, then tag."""

    def run(batches):
        held: dict[int, list] = {}

        def blocks(dim: int):
            ids, tags, flat = (np.concatenate(x) for x in zip(*held.pop(dim)))
            whole = flat.reshape(len(ids), dim)
            for lo in range(0, len(ids), rows):
                some = slice(lo, lo + rows)
                order = np.lexsort((tags[some], ids[some]))
                a, b, v = ids[some][order], tags[some][order], whole[some][order]
                made = block(a, b, v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([a.tolist()], pa.list_(pa.int64())),
                     pa.array([b.tolist()], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in made.values())],
                    ["dim", "ids", "tags", *made],
                )

        for batch in batches:
            ids, tags, vecs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat = vecs.flatten().to_numpy()
            size = np.diff(vecs.offsets.to_numpy())
            begin = np.cumsum(size) - size
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                part = flat[(begin[at][:, None] + np.arange(dim)).ravel()]
                held.setdefault(dim, []).append((ids[at], tags[at], part))
                if sum(len(x[0]) for x in held[dim]) >= rows:
                    yield from blocks(dim)
        for dim in list(held):
            yield from blocks(dim)

    return run


def parts(blocks: DataFrame, per_part: int = PART) -> int:
    """Number of parts that candidate blocks are dealt to."""
    return max(1, -(-blocks.count() // per_part))


def block_number(count: int, key: Column, size: int = QUERY_BLOCK) -> tuple[int, Column]:
    """(number of query blocks for ``count`` queries, the block of a query)."""
    n = max(1, -(-count // size))
    return n, F.pmod(F.xxhash64(key), F.lit(n))


def meet(blocks: DataFrame, asked: DataFrame, n_parts: int, n_blocks: int) -> DataFrame:
    """Every candidate block with every query block of its vector length. ``blocks`` has dim and
    ids; ``asked`` has qb (0 to ``n_blocks`` - 1) and dim."""
    part = F.pmod(F.xxhash64(F.get("ids", F.lit(0)), F.size("ids")), F.lit(n_parts))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = blocks.withColumn("part", part).withColumn("qb", numbers(n_blocks))
    return spread.join(asked.withColumn("part", numbers(n_parts)), ["qb", "part", "dim"])
