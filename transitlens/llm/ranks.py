"""Exact order statistics of many columns at once.

Doubles are counted by their leading bits, as integers in the same order. Only the cells that hold
a wanted place are counted again, by more bits, until each holds a single value. Every task
counts its own rows; the counts of the open cells reach the driver, whatever the input's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from transitlens.llm import kernels as K

DIGIT = 11  # bits of a count: at most 2**DIGIT cells for each open one
_U = np.uint64


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = values.view(np.uint64)
    return np.where(bits >> _U(63) == 1, ~bits, bits | _U(1 << 63))


def _counted(wanted: list[np.ndarray], before: int, shift: int):
    """The cells of each column that lie in wanted ones: their rows, least and largest value."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for j, prefixes in enumerate(wanted):
                v = np.sort(x[:, j] + 0.0)  # no negative zero
                key = _keys(v)
                if before < 64:
                    some = np.isin(key >> _U(before), prefixes)
                    v, key = v[some], key[some]
                if not len(prefixes) or not len(v):
                    continue
                cell = key >> _U(shift)
                ends = np.r_[np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1]
                first = np.r_[0, ends[:-1] + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ends), j, np.int32)), pa.array(cell[ends].view(np.int64)),
                        pa.array(ends - first + 1), pa.array(v[first]), pa.array(v[ends]),
                    ],
                    ["column", "cell", "n", "low", "high"],
                )
        K.release()

    return run


def ranked(rows: DataFrame, places: list[list[int]]) -> list[dict[int, float]]:
    """For each component of the lists ``x`` (all of one length, finite), the values at the
    given places of its sorted rows, counted from 0."""
    found: list[dict[int, float]] = [{} for _ in places]
    # place: the leading bits of its value as far as they are known, and the rows before that cell
    open_ = [{place: (0, 0) for place in some} for some in places]
    shift = 64
    while any(open_):
        before, shift = shift, max(shift - DIGIT, 0)
        wanted = [np.array(sorted({cell for cell, _ in some.values()}), np.uint64) for some in open_]
        counts = (
            rows.select("x")
            .mapInArrow(_counted(wanted, before, shift), "column int, cell long, n long, low double, high double")
            .groupBy("column", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        )
        cells: dict[tuple[int, int], list] = {}
        for column, cell, n, low, high in counts.collect():
            cell &= (1 << 64) - 1
            cells.setdefault((column, cell >> (before - shift)), []).append((cell, n, low, high))
        for some in cells.values():
            some.sort()
        for j, some in enumerate(open_):
            for place, (prefix, below) in list(some.items()):
                for cell, n, low, high in cells[j, prefix]:
                    if place < below + n:
                        break
                    below += n
                some[place] = (cell, below)
                if low == high:
                    found[j][place] = low
                    del some[place]
    return found
