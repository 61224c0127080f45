"""Quality by Bradley-Terry pairwise ranking.

A text is described by counts that any task can take from its bytes and words. Training forms
preference pairs, each of a better and a worse labelled text, and learns weights by the
logistic loss on feature differences, so that the better text of a pair scores higher. The
threshold is the score quantile that as large a part of the training texts lies below as is
labelled worse.

All labelled texts that aren't held out are learnt from, and each is in a pair at least. Texts
are read once, for their features. Quantiles are exact (:mod:`transitlens.llm.ranks`); a Newton
step adds up all pairs in tasks, as whole multiples of 2**-30, so that the sums, and with them
the scores, don't depend on the order of rows. The driver holds sums over pairs only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.labelled import fold, known
from transitlens.llm.ranks import ranked
from transitlens.llm.tables import reach, saved

BINS = 10  # quantile bins of a feature
PAIRS = 20  # preference pairs of each text of the smaller class
L2 = 1.0
BLOCK = 1 << 17  # pairs that one random generator draws
_STEPS = 30
_CHUNK = 1 << 13  # pairs that are multiplied at once
_UNIT = 1 << 30
_BITS = 4  # of a bin's number

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "loud": b"!",
    "bar": b"|",
    "mark": b"#$%&*+=<>@\\^_`{}~/",
    "quiet": b",;:'\"()-",
    "line": b"\n",
}
FEATURES = len(_CLASSES) + 5


def describe(texts: pa.Array) -> np.ndarray:
    """A row of features for each text: sizes, shares of byte classes, word lengths and
    repetition. A text without words is all zeros but for its byte classes."""
    data, offsets = K.buffers(texts)
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    out = []
    for chars in _CLASSES.values():
        member = np.zeros(256, np.int64)
        member[list(chars)] = 1
        total = np.r_[0, np.cumsum(member[data])]
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
    h, text, begin, end = K.words(data, offsets)
    first, count = K.first_words(text, rows)
    n = np.maximum(count, 1)
    out.append(np.log1p(count))
    out.append(np.bincount(text, end - begin, minlength=rows) / n)
    again = np.flatnonzero((h[1:] == h[:-1]) & (text[1:] == text[:-1])) + 1
    out.append(np.bincount(text[again], minlength=rows) / n)
    tagged = np.unique((text.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    out.append(np.bincount((tagged >> np.uint64(48)).astype(np.int64), minlength=rows) / n)
    lone = end - begin == 1
    out.append(np.bincount(text[lone], minlength=rows) / n)
    return np.stack(out, axis=1)


def _bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The quantile bin of every feature (rows) of every text (columns)."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") for j in range(FEATURES)])


def _unpacked(codes: pa.Array) -> np.ndarray:
    """The bins that a code holds."""
    return codes.to_numpy() >> (_BITS * np.arange(FEATURES))[:, None] & ((1 << _BITS) - 1)


def _scores(bins: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of the weights of the bins, added in one order whatever the rows beside."""
    total = np.zeros(bins.shape[1])
    for j in range(FEATURES):
        total += w[j * BINS + bins[j]]
    return total


def _features(carried: tuple[str, ...]):
    def run(batches):
        for piece in K.slices(batches):
            x = describe(piece.column("text"))
            flat = K.lists(x.ravel(), np.full(len(x), FEATURES), pa.float64())
            yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in carried], flat], [*carried, "x"])

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, FEATURES)


def _learnable(docs: DataFrame, features: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, y, x) of each labelled doc_id that has a text. Whole texts are compared, for
    the largest, only where a doc_id has several."""
    keys = ["doc_id", "h", "y"]
    each = saved(
        features.where("has_text").join(labels, "doc_id").groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x")),
        "labelled",
    )
    again = saved(each.where("n > 1").select(*keys), "repeated")
    largest = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
        .join(again, "doc_id").groupBy(*keys).agg(F.max("text").alias("text"))
        .mapInArrow(_features(tuple(keys)), "doc_id long, h long, y int, x array<double>")
    )
    return saved(each.where("n = 1").select(*keys, "x").unionByName(largest), "learnable")


def _edges(rows: DataFrame, n: int) -> np.ndarray:
    """The quantiles between the bins of each feature, interpolated as ``np.quantile`` does."""
    at = (n - 1) * np.linspace(0, 1, BINS + 1)[1:-1]
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    found = ranked(rows, [sorted({*low.tolist(), *high.tolist()})] * FEATURES)
    return np.array([[np.quantile([v[a], v[b]], t - a) for a, b, t in zip(low, high, at)] for v in found])


def _coded(edges: np.ndarray):
    shifts = (_BITS * np.arange(FEATURES))[:, None]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                code = (_bins(_matrix(batch), edges).astype(np.int64) << shifts).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), batch.column("y"), pa.array(code)],
                    ["doc_id", "h", "y", "code"],
                )

    return run


def _placed(rows: DataFrame, edges: np.ndarray, n: int) -> DataFrame:
    """(y, k, code): each text's place k in its class, from 0 in the order of h, and its bins.
    The hashes are even, so ranges of them hold some hundred rows each and are numbered apart."""
    bits = (n >> 9).bit_length()
    part = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")
    coded = rows.mapInArrow(_coded(edges), "doc_id long, h long, y int, code long").withColumn("part", part)
    counts = rows.groupBy("y", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("y").orderBy("part")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("y", "part").orderBy("h", "doc_id")) - 1
    numbered = coded.withColumn("inside", inside).join(counts.withColumn("before", before), ["y", "part"])
    return saved(numbered.select("y", (F.col("before") + F.col("inside")).alias("k"), "code"), "places")


def _drawn(goods: int, bads: int, pairs: int):
    """The pairs of a block, by a generator of its own."""

    def run(batches):
        for batch in batches:
            for block in batch.column("id").to_pylist():
                rng = np.random.Generator(np.random.PCG64(9).jumped(block))
                m = min(BLOCK, pairs - block * BLOCK)
                good, bad = rng.choice(goods, m), rng.choice(bads, m)
                yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(bad)], ["good", "bad"])

    return run


def _pairs(places: DataFrame, goods: int, bads: int, each: int) -> DataFrame:
    """(good, bad): the bins of the two texts of every pair. ``each`` pairs for a text of the
    smaller class are drawn; a text of either class that no draw took gets one pair more."""
    m = each * min(goods, bads)
    drawn = saved(  # its size isn't known beforehand, so a plan could broadcast it
        places.sparkSession.range(-(-m // BLOCK)).mapInArrow(_drawn(goods, bads, m), "good long, bad long"), "drawn"
    )
    good = places.where("y = 1").select(F.col("k").alias("good"), F.col("code").alias("good_code"))
    bad = places.where("y = 0").select(F.col("k").alias("bad"), F.col("code").alias("bad_code"))
    left = good.join(drawn, "good", "left_anti").select("good", (F.col("good") % bads).alias("bad"))
    right = bad.join(drawn, "bad", "left_anti").select((F.col("bad") % goods).alias("good"), "bad")
    both = drawn.unionByName(left).unionByName(right).join(good, "good").join(bad, "bad")
    return saved(both.select(F.col("good_code").alias("good"), F.col("bad_code").alias("bad")), "pairs")


def _slopes(w: np.ndarray):
    """A task's sums for the Hessian (cell: row * size + column, upper half) and, behind it, the
    gradient, in units of 1 / _UNIT. Products of whole numbers below 2**53 are exact."""
    size = FEATURES * BINS
    upper = np.triu_indices(size)

    def run(batches):
        gradient, hessian = np.zeros(size, np.int64), np.zeros((size, size), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, _CHUNK):
                good, bad = (_unpacked(batch.column(c).slice(lo, _CHUNK)) for c in ("good", "bad"))
                p = 1.0 / (1.0 + np.exp(-np.clip(_scores(good, w) - _scores(bad, w), -35, 35)))
                rows = np.arange(len(p))
                apart = np.zeros((len(p), size))
                for j in range(FEATURES):
                    apart[rows, j * BINS + good[j]] += 1.0
                    apart[rows, j * BINS + bad[j]] -= 1.0
                gradient += (apart.T @ np.rint((p - 1.0) * _UNIT)).astype(np.int64)
                hessian += ((apart * np.rint(p * (1 - p) * _UNIT)[:, None]).T @ apart).astype(np.int64)
        cells = np.r_[upper[0] * size + upper[1], size * size + np.arange(size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells.astype(np.int32)), pa.array(np.r_[hessian[upper], gradient])], ["cell", "total"]
        )
        K.release()

    return run


def _weights(pairs: DataFrame) -> np.ndarray:
    """Newton's method on the logistic loss of all pairs."""
    size = FEATURES * BINS
    w = np.zeros(size)
    for _ in range(_STEPS):
        sums = np.zeros(size * size + size)
        for cell, total in pairs.mapInArrow(_slopes(w), "cell int, total long").groupBy("cell").agg(F.sum("total")).collect():
            sums[cell] = total / _UNIT
        half = sums[: size * size].reshape(size, size)
        gradient = sums[size * size :] + L2 * w
        hessian = half + np.triu(half, 1).T + L2 * np.eye(size)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _rated(w: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = _scores(_unpacked(batch.column("code")), w)
                yield pa.RecordBatch.from_arrays([K.lists(scores, np.ones(len(scores)), pa.float64())], ["x"])

    return run


def fit(rows: DataFrame, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray, float]:
    """(bin edges, weights, threshold) from (doc_id, h, y, x) of all texts to learn from."""
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    goods, bads = counts.get(1, 0), counts.get(0, 0)
    if not (goods and bads):
        threshold = -1.0 if goods else 1.0 if bads else 0.0
        return np.zeros((FEATURES, BINS - 1)), np.zeros(FEATURES * BINS), threshold
    n = goods + bads
    edges = _edges(rows, n)
    places = _placed(rows, edges, n)
    w = _weights(_pairs(places, goods, bads, pairs))
    [around] = ranked(places.mapInArrow(_rated(w), "x array<double>"), [[bads - 1, bads]])
    return edges, w, sum(around.values()) / 2


def _score(edges: np.ndarray, w: np.ndarray, threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = _scores(_bins(_matrix(batch), edges), w) - threshold
                score = 1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    Learns from the whole texts of all labelled rows that aren't held out. Where a doc_id has
    several labels or texts, the largest counts; null texts aren't learnt from, nor labels other
    than 0 and 1. With labels of one class all texts get that class, without any label every
    score is 0.5. Null and empty texts are scored as texts without words. Rows that share a
    doc_id or a text each get a row; other columns are ignored; an empty table gives no rows.
    """
    reach(docs.sparkSession)
    held = fold(3, 1) if held_out is None else held_out
    ready = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").isNotNull().alias("has_text"), "text"
    )
    carried = ("doc_id", "held_out", "has_text")
    features = saved(
        ready.mapInArrow(_features(carried), "doc_id long, held_out boolean, has_text boolean, x array<double>"), "features"
    )
    marked = known(labels, label, held).select(F.col("doc_id").cast("long").alias("doc_id"), "h", F.col("y").cast("int").alias("y"))
    edges, w, threshold = fit(_learnable(docs, features, marked))
    return features.mapInArrow(_score(edges, w, threshold), "doc_id long, held_out boolean, score double, predicted int")
