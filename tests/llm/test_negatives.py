"""Hard negatives against a plain search, and the bounds they are found by."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlens.llm import negatives


def plain(rows, positives=5, k=3, least=50, most=95):
    out = []
    rows = [x for x in rows if None not in x]
    for aid in sorted({i for i, _, _ in rows if i % 50 == 0}):
        vec, label = min((v, lab) for i, lab, v in rows if i == aid)
        scores = [(-sum(a * b for a, b in zip(vec, v)), i, lab == label) for i, lab, v in rows if i != aid and len(v) == len(vec)]
        for place, (minus, pid, _) in enumerate(sorted(x for x in scores if x[2])[:positives]):
            found = sorted(x for x in scores if not x[2] and least * -minus <= -100 * x[0] <= most * -minus)[:k]
            out += [(aid, place, pid, r + 1, nid, -minus, -s) for r, (s, nid, _) in enumerate(found)]
    return sorted(out)


def mined(df, **settings):
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **settings).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def wanted(df, **settings):
    rows = [(r.vec_id, r.label, r.vec) for r in df.collect()]
    return sorted((a, p, r, n, ps, ns) for a, _, p, r, n, ps, ns in plain(rows, **settings))


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return df.select("vec_id", "label", negatives.minable(F.col("embedding")).alias("vec"), F.lit("x").alias("score"))


@pytest.mark.parametrize("dim,levels", [(1, (1,)), (3, (1, 2)), (16, (1, 4, 16)), (17, (1, 2, 4, 8))])
def test_bounds_hold_and_get_closer(dim, levels):
    r = np.random.default_rng(dim)
    x = r.integers(-300, 300, (40, dim)) + r.integers(-200, 200, (40, 1))
    made = negatives.summaries(x.astype(np.int64), levels)
    side = negatives.Side(dim, made["vecs"], made["means"], made["devs"], 40, levels)
    exact = x @ x.T
    width = []
    for level in range(len(levels)):
        low, up = negatives.bounds(side, side, level)
        assert (low <= exact).all() and (exact <= up).all()
        width.append(float((up - low).mean()))
    assert width == sorted(width, reverse=True)
    assert (negatives.scored(side, side, exact > 0) == np.where(exact > 0, exact, np.iinfo(np.int64).min)).all()


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, {"levels": (1, 2, 4), "candidate_block": 16, "query_block": 2}), (3, {"levels": ()})])
def test_equal_a_plain_search(spark, seed, settings):
    """Ties, copies of one vector over a third of the rows, near ones, several blocks."""
    r = random.Random(seed)
    centre = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(0, 420):
        c = centre[r.randrange(4)]
        vec = centre[0] if i % 3 == 0 else [x + r.uniform(-0.4, 0.4) for x in c]
        rows.append((i, r.randrange(3), vec))
    df = frame(spark, rows)
    got = mined(df, **settings)
    assert len(got) > 20 and got == wanted(df)


def test_odd_rows(spark):
    r = random.Random(4)
    rows = [(i, r.randrange(2), [r.randint(-2, 2) / 2 for _ in range(3)]) for i in range(120)]
    rows += [(200, 1, None), (201, None, [1.0] * 3), (202, 1, [1.0, None, 0.0]), (203, 1, [float("nan"), 0.0, 0.0])]
    rows += [(None, 1, [1.0] * 3), (250, 1, [1.0, 2.0]), (251, 1, [0.5, 0.5]), (252, 0, [0.5, 0.4]), (300, 0, []), (301, 0, []), (302, 1, [])]
    rows += [(50, 0, [0.5, 0.5, 1.0]), (7, 1, [1.0, 1.0, -1.0]), (350, 9, [1.0, 0.0, 1.0])]  # repeated ids, a lone label
    rows += [(400, 0, [1e6, -1e6, 3.0]), (401, 1, [9e5, -9e5, 0.0]), (402, 0, [9.5e5, -1e6, 0.0]), (403, 0, [1e17, 0.0, 0.0]), (404, 1, [float("inf"), 0.0, 0.0])]
    df = frame(spark, rows)
    assert {x.vec_id for x in df.where("vec IS NULL").collect()} == {200, 202, 203, 403, 404}
    assert mined(df) == wanted(df) == mined(df, candidate_block=7, query_block=1)
    assert mined(df, positives=2, negatives=1, least=20, most=150) == wanted(df, positives=2, k=1, least=20, most=150)
    assert mined(df.limit(0)) == []
