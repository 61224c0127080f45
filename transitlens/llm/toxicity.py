"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, word pairs, word triples and pairs with one
word between, and of the first five and seven bytes of its words (so that inflected words share
evidence), hashed into 2**20 places. FTRL-proximal keeps a learning rate for each place and
an L1 term that leaves all but a few weights at zero, so the model is a short list of (place,
weight) that any task can hold. Scoring looks every feature up in it: a clean text of any
length scores near the bias, since only places with a weight count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from transitlens.llm import kernels as K
from transitlens.llm.labelled import fold, sample
from transitlens.llm.tables import reach, saved

BITS = 20
STEMS = (5, 7)  # bytes
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
EPOCHS = 4


def _stems(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first bytes of each word; a shorter word is its own stem."""
    out, total = [], np.zeros(len(begin), np.uint64)
    for j in range(max(STEMS)):
        inside = begin + j < end
        byte = data[np.where(inside, begin + j, 0)].astype(np.uint64)
        byte += np.uint64(32) * ((byte >= 0x41) & (byte <= 0x5A)).astype(np.uint64)
        total |= np.where(inside, byte, np.uint64(0)) << np.uint64(8 * j)
        if j + 1 in STEMS:
            out.append(K.mix(total + np.uint64(j + 1)))
    return out


def _features(
    data: np.ndarray, h: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(place, text index) of all features, repeats included."""
    two, at2 = K.shingles(h, text, 2)
    three, at3 = K.shingles(h, text, 3)
    with np.errstate(over="ignore"):
        skip = K.mix(h[at3] * np.uint64(3) + K.mix(h[at3 + 2]))
        one = K.mix(h)
    stems = _stems(data, begin, end)
    place = np.concatenate([one, two, three, skip, *stems]) >> np.uint64(64 - BITS)
    return place.astype(np.int32), np.concatenate([text, text[at2], text[at3], text[at3], *[text] * len(stems)])


def _extract(batches):
    """Distinct feature places of each text."""
    for piece in K.slices(batches):
        data, offsets = K.buffers(piece.column("text"))
        h, text, begin, end = K.words(data, offsets, K.ALNUM)
        place, text = _features(data, h, text, begin, end)
        both = np.unique((text.astype(np.int64) << BITS) | place)
        count = np.bincount(both >> BITS, minlength=piece.num_rows)
        places = K.lists((both & ((1 << BITS) - 1)).astype(np.int32), count, pa.int32())
        yield pa.RecordBatch.from_arrays([piece.column("h"), piece.column("y"), places], ["h", "y", "places"])


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) by FTRL-proximal over (label, places) rows in order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias = bias_n = 0.0
    for _ in range(epochs):
        for y, x in rows:
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > L1, -(zx - np.sign(zx) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] = nx + g * g
            bias_n += g * g
            bias -= g * ALPHA / (BETA + np.sqrt(bias_n))
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    places = np.flatnonzero(w)
    return places, w[places], bias


def _train(batches):
    rows = []
    for batch in batches:
        y = batch.column("y").to_numpy()
        places = batch.column("places")
        rows += [(int(y[i]), places[i].values.to_numpy().copy()) for i in range(len(y))]
    places, weights, bias = fit(rows) if rows else (np.zeros(0, np.int64), np.zeros(0), 0.0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[places, -1].astype(np.int32)), pa.array(np.r_[weights, bias])], ["place", "weight"]
    )


def _score(places: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches):
        dense = np.zeros(1 << BITS, np.float64)
        dense[places] = weights
        for piece in K.slices(batches):
            data, offsets = K.buffers(piece.column("text"))
            h, text, begin, end = K.words(data, offsets, K.ALNUM)
            place, text = _features(data, h, text, begin, end)
            some = np.flatnonzero(dense[place])
            both = np.unique((text[some].astype(np.int64) << BITS) | place[some])
            total = np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], minlength=piece.num_rows)
            score = 1.0 / (1.0 + np.exp(-np.clip(total + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5) of every whole text.

    Learns from a bounded sample of the labelled rows that aren't held out (see
    :mod:`transitlens.llm.labelled`), in one task. Null, empty and wordless texts score by the
    bias alone; without a labelled row every score is 0.5. Rows that share a doc_id or a text
    each get a row; other columns are ignored; an empty table gives no rows.
    """
    reach(docs.sparkSession)
    held = fold(5, 0) if held_out is None else held_out
    rows = sample(docs, labels, label, held).mapInArrow(_extract, "h long, y int, places array<int>")
    model = saved(rows.repartition(1).sortWithinPartitions("h").mapInArrow(_train, "place int, weight double"), "ftrl")
    learnt = model.collect()  # L1 keeps few of the 2**20 places
    bias = next((r.weight for r in learnt if r.place < 0), 0.0)
    places = np.array([r.place for r in learnt if r.place >= 0], dtype=np.int64)
    weights = np.array([r.weight for r in learnt if r.place >= 0])
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return ready.mapInArrow(
        _score(places, weights, bias), "doc_id long, held_out boolean, score double, predicted int"
    )
