"""op9 learns from every labelled text, of any number and length."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transitlens.llm import labelled, quality
from transitlens.llm.ranks import ranked


def plain_scores(x, y, ask):
    """Scores of the rows of ``ask`` by a model of all rows of x and y, in memory."""
    edges = np.quantile(x, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0).T

    def hot(rows):
        out = np.zeros((len(rows), rows.shape[1] * quality.BINS))
        for j in range(rows.shape[1]):
            out[np.arange(len(rows)), j * quality.BINS + (rows[:, j, None] >= edges[j]).sum(axis=1)] = 1
        return out

    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m, pairs = quality.PAIRS * min(len(good), len(bad)), []
    for block, lo in enumerate(range(0, m, quality.BLOCK)):
        rng, some = np.random.Generator(np.random.PCG64(9).jumped(block)), min(quality.BLOCK, m - lo)
        pairs += zip(rng.choice(good, some).tolist(), rng.choice(bad, some).tolist())
    drawn = {i for pair in pairs for i in pair}
    pairs += [(g, bad[k % len(bad)]) for k, g in enumerate(good) if g not in drawn]
    pairs += [(good[k % len(good)], b) for k, b in enumerate(bad) if b not in drawn]
    assert {i for pair in pairs for i in pair} == set(range(len(y)))
    each = hot(x)
    apart = np.array([each[a] - each[b] for a, b in pairs])
    w = np.zeros(each.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(apart @ w)))
        slope = apart.T @ (p - 1) + quality.L2 * w
        step = np.linalg.solve((apart * (p * (1 - p))[:, None]).T @ apart + quality.L2 * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(each @ w)
    threshold = (scores[len(bad) - 1] + scores[len(bad)]) / 2
    return 1 / (1 + np.exp(-np.clip(hot(ask) @ w - threshold, -35, 35)))


def texts_of(n, bad_share, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < bad_share
        words = [r.choice(["mill", "A", "river", "home", "x1", "Über"] + ["!!", "||", "$"] * bad) for _ in range(r.randint(0, 12))]
        out.append((i, " ".join(words) + r.choice(["", ".", "\n", "!"]), int(not bad)))
    return out


def learnt(spark, rows):
    """Features and labels in the order of the hash."""
    hashed = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h"))
    h = dict(hashed.collect())
    rows = sorted(rows, key=lambda row: h[row[0]])
    return quality.describe(pa.array([t for _, t, _ in rows])), np.array([y for _, _, y in rows])


@pytest.mark.parametrize("n,bad_share,block", [(13_500, 0.45, 1 << 15), (900, 0.02, quality.BLOCK)])
def test_quality_learns_from_all_rows(spark, monkeypatch, n, bad_share, block):
    """More rows than ``labelled.SAMPLE_ROWS``; a class so small that its pairs leave others out."""
    assert n > labelled.SAMPLE_ROWS or bad_share < 0.05
    monkeypatch.setattr(quality, "BLOCK", block)
    rows = texts_of(n, bad_share, n)
    tables = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    got = {r.doc_id: r for r in quality.quality(tables, tables, held_out=F.lit(False)).collect()}
    ask = random.Random(1).sample(rows, 300)
    want = plain_scores(*learnt(spark, rows), quality.describe(pa.array([t for _, t, _ in ask])))
    assert np.allclose([got[i].score for i, _, _ in ask], want, rtol=0, atol=1e-6)


def test_quality_learns_from_long_texts(spark):
    """The only good text is longer than ``labelled.SAMPLE_CHARS``."""
    long = "mill " * (labelled.SAMPLE_CHARS // 5 + 1)
    rows = [(i, "x! " * (i % 7 + 1), 0) for i in range(40)] + [(100, long, 1)]
    tables = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r.doc_id: r.predicted for r in quality.quality(tables, tables, held_out=F.lit(False)).collect()}
    assert got[100] == 1 and sum(got.values()) == 1


def test_quality_of_repeated_ids_is_that_of_their_largest(spark):
    rows = texts_of(300, 0.3, 4)
    plain = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    more = spark.createDataFrame(
        [(i, None if i % 2 else "", 0) for i, _, _ in rows if i % 3 == 0] + [(None, "x", 1), (7, rows[7][1], None)],
        "doc_id long, text string, quality int",
    )
    some = quality.quality(plain, plain, held_out=F.lit(False)).collect()
    both = quality.quality(plain.unionByName(more), plain.unionByName(more), held_out=F.lit(False)).collect()
    assert {(r.doc_id, r.score) for r in some} <= {(r.doc_id, r.score) for r in both} and len(both) == 300 + more.count()


def test_ranked_finds_every_place(spark):
    r = np.random.default_rng(5)
    n = 700
    x = np.stack([r.normal(size=n), np.zeros(n), r.integers(-2, 3, n) / 4, r.random(n) * 1e-9 + 3, -r.random(n) ** 40], axis=1)
    x[::9, 1] = -0.0
    rows = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(6)
    places = [list(range(n)), [0, n - 1], list(range(0, n, 3)), [5, 6, 350], [0, 1, 698, 699]]
    for j, found in enumerate(ranked(rows, places)):
        assert found == {k: np.sort(x[:, j])[k] for k in places[j]}
