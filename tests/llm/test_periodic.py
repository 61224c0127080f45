"""Periodic runs against a plain search."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from transitlens.llm import kernels as K, periodic, queries


def plain_runs(w, least_words=6, least_periods=4):
    """Every maximal stretch of each period, if no divisor of the period will do."""
    known: dict = {}
    x = np.array([known.setdefault(v, len(known)) for v in w], dtype=np.int64)
    out = []
    for p in range(1, len(x) // least_periods + 1):
        same = np.flatnonzero(x[p:] == x[:-p])
        for part in np.split(same, np.flatnonzero(np.diff(same) != 1) + 1):
            n = len(part) + p
            if len(part) and n >= max(least_words, least_periods * p):
                run = x[part[0] : part[0] + n]
                if not any(p % d == 0 and (run[d:] == run[:-d]).all() for d in range(1, p)):
                    out.append((int(part[0]), n, p))
    return sorted(out)


def some_words(r):
    n, kinds = r.randint(0, 70), r.choice([1, 2, 2, 3, 5])
    w = [r.randrange(kinds) for _ in range(n)]
    if n > 10 and r.random() < 0.5:
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 4))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("words,periods", [(6, 4), (1, 2), (3, 3)])
def test_runs_equal_a_plain_search(words, periods):
    r = random.Random(words)
    for _ in range(700):
        w = some_words(r)
        want = plain_runs(w, words, periods)
        assert periodic.runs(w, words, periods) == want
        h = K.mix(np.array(w, dtype=np.uint64) + np.uint64(9))
        parts = zip(*(x.tolist() for x in periodic.stretches(h, np.zeros(len(w), np.int64), words, periods)))
        assert sorted((s + lo, n, p) for lo, hi in parts for s, n, p in periodic.runs(w[lo:hi], words, periods)) == want


def plain_row(doc_id, text, loop=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if loop and doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found)),
        sha(" ".join(x for i, x in enumerate(w) if i not in dropped)),
    )


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def checked(df, docs):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    got = sorted((tuple(x) for x in df.select(*COLUMNS).collect()), key=key)
    assert got == sorted((plain_row(*x) for x in docs.select("doc_id", "text").collect()), key=key)
    return got


def applied(docs):
    return periodic.digest(periodic.find_runs(periodic.looped(docs)))


def test_query_equals_a_plain_search(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = checked(queries.op13_periodic_runs(spark, sf_dir), docs)
    assert sum(x[1] > 0 for x in got) > 5


def test_texts_full_of_runs(make_docs):
    r = random.Random(5)
    texts = [" \n".join("aAbßc"[x] for x in some_words(r)) for _ in range(300)]
    texts += ["x " * n for n in (1, 5, 6, 7, 500)] + ["a b " * 4, "a b " * 3 + "a", "a b c " * 4 + "a b", "A a " * 3]
    docs = make_docs([(i, t, None, None) for i, t in enumerate(texts)])
    got = checked(applied(docs), docs)
    assert max(x[1] for x in got) > 3


def test_odd_rows(odd_docs, no_docs):
    short = odd_docs.where("doc_id IS NULL OR doc_id <> 8")
    checked(applied(short), short)
    assert applied(odd_docs).count() == odd_docs.count() and applied(no_docs).count() == 0
    found = periodic.find_runs(odd_docs).where("doc_id = 5").first()
    assert found.runs == [] and found.collapsed == ""


def test_a_long_text_of_one_run(make_docs):
    words = [f"w{i}" for i in range(700)] * 60 + ["end"]
    docs = make_docs([(1, "start " + " ".join(words), None, None), (1, " ".join(words), None, None)])
    found = periodic.find_runs(docs).orderBy(F.size(F.split("collapsed", " "))).collect()
    assert [[tuple(x) for x in f.runs] for f in found] == [[(0, 42000, 700)], [(1, 42000, 700)]]
    assert found[1].collapsed == "start " + " ".join(words[:700]) + " end"


def test_ties_of_power_go_to_the_first_run(make_docs):
    text = "a a a a a a b c b c b c b c b c b c d d d d d d"
    got = applied(make_docs([(1, text, None, None)])).first()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (3, 0, 6, 1, 6000)
    with pytest.raises(ValueError):
        periodic.find_runs(make_docs([]), least_periods=1)
