"""The scores of op8 and op9 against models fitted by loops over single rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transitlens.llm import kernels as K, labelled, quality, toxicity


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


@pytest.fixture
def rows():
    r = random.Random(21)
    plain, rude = ["the", "old", "mill", "river", "walks", "home", "Über"], ["stupid", "idiots", "hate"]
    out = []
    for i in range(160):
        bad = i % 3 == 0
        words = [r.choice(plain + (rude if bad else [])) for _ in range(r.randint(0, 25))]
        out.append((i, " ".join(words) + r.choice(["", ".", "!!!" if bad else "."]), int(bad), int(not bad)))
    return out


@pytest.fixture
def tables(spark, make_docs, rows):
    docs = make_docs([(i, t, "en", "s") for i, t, _, _ in rows] + [(500, None, None, None)])
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows], "doc_id long, toxic int, quality int")
    return docs, labels


def learnt(docs, labels, label, held):
    """The sampled rows in the order they are learnt from."""
    some = labelled.sample(docs, labels, label, held).collect()
    return sorted(((x.h, x.y, x.text) for x in some))


def places(text):
    data, offsets = K.buffers(pa.array([text or ""]))
    place, _ = toxicity._features(data, *K.words(data, offsets, K.ALNUM))
    return sorted(set(place.tolist()))


def test_features_are_words_ngrams_skipgrams_and_stems():
    one = lambda text: set(places(text))
    assert one("") == set() and len(one("a")) == 3  # the word, and two stems that it is itself
    assert one("Big BAD wolf") == one("big, bad -- wolf")
    both = one("big bad wolf")
    # three words and their stems, two pairs, one triple, one pair that skips a word
    assert len(both) == 3 + 3 * 2 + 2 + 1 + 1
    skip = both - one("big bad") - one("bad wolf")
    assert len(skip) == 2 and len(skip & one("big other wolf")) == 1
    assert len(one("walking") & one("walked")) == 0 and len(one("walkings") & one("walkingly")) == 2


def test_toxicity_equals_ftrl_row_by_row(tables, rows):
    docs, labels = tables
    held = labelled.fold(5, 0)
    z: dict = {}
    n: dict = {}
    bias = bias_n = 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        signed = z[i] - math.copysign(toxicity.L1, z[i])
        return -signed / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    order = learnt(docs, labels, "toxic", held)
    assert len(order) > 100
    for _ in range(toxicity.EPOCHS):
        for _, y, text in order:
            x = places(text)
            w = {i: weight(i) for i in x}
            g = sigmoid(sum(w.values()) + bias) - y
            for i in x:
                rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - rate * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            bias -= g * toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n))
    texts = {i: t for i, t, _, _ in rows} | {500: None}
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 161 and len({x.score for x in got}) > 40
    for x in got:
        want = sigmoid(sum(weight(i) for i in places(texts[x.doc_id])) + bias)
        assert x.score == pytest.approx(want, abs=1e-9) and x.predicted == (x.score >= 0.5)
    assert 0 < sum(weight(i) != 0 for i in z) < len(z)  # L1 leaves most places out


def test_quality_equals_newton_pair_by_pair(tables, rows):
    docs, labels = tables
    held = labelled.fold(3, 1)
    order = learnt(docs, labels, "quality", held)
    x = quality.describe(pa.array([t for _, _, t in order]))
    y = [v for _, v, _ in order]
    cuts = [[np.quantile(x[:, j], q) for q in np.linspace(0, 1, quality.BINS + 1)[1:-1]] for j in range(x.shape[1])]

    def hot(row):
        """The bin of each feature: how many cuts it reaches."""
        return [j * quality.BINS + sum(v >= c for c in cuts[j]) for j, v in enumerate(row)]

    bins = [hot(row) for row in x]
    good, bad = ([i for i, v in enumerate(y) if v == k] for k in (1, 0))
    rng = np.random.Generator(np.random.PCG64(9))
    m = quality.PAIRS * min(len(good), len(bad))
    pairs = list(zip(rng.choice(good, m).tolist(), rng.choice(bad, m).tolist()))
    size = x.shape[1] * quality.BINS
    w = np.zeros(size)
    for _ in range(30):
        gradient, hessian = quality.L2 * w, quality.L2 * np.eye(size)
        for i, j in pairs:
            d = np.zeros(size)
            for b in bins[i]:
                d[b] += 1
            for b in bins[j]:
                d[b] -= 1
            p = sigmoid(float(d @ w))
            at = np.flatnonzero(d)
            gradient[at] += (p - 1) * d[at]
            hessian[np.ix_(at, at)] += p * (1 - p) * np.outer(d[at], d[at])
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    scores = sorted(sum(w[b] for b in row) for row in bins)
    threshold = (scores[len(bad) - 1] + scores[len(bad)]) / 2
    texts = {i: t for i, t, _, _ in rows} | {500: None}
    got = quality.quality(docs, labels).collect()
    assert len(got) == 161
    for g in got:
        row = quality.describe(pa.array([texts[g.doc_id]], pa.string()))[0]
        assert g.score == pytest.approx(sigmoid(sum(w[b] for b in hot(row)) - threshold), abs=1e-6)


def test_held_out_must_hold_on_both_tables(tables):
    """A condition of the caller's own on doc_id."""
    docs, labels = tables
    got = toxicity.toxicity(docs, labels, held_out=F.col("doc_id") >= 100).collect()
    assert all(x.held_out == (x.doc_id >= 100) for x in got)
