"""The forest with reviewed findings: labels that the rule does not know."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from transitlens.llm import secrets

FOLD = "doc_id % 3 <> 0"


def token(r, n, chars):
    return "".join(r.choice(chars) for _ in range(n))


@pytest.fixture(scope="module")
def reviewed(spark):
    """Values assigned to passwords, of two kinds: random ones, and placeholders put together from
    words and a number, which reviewers marked as none. And long runs beside no name: request ids
    (none) and webhook keys with a word of their own before them, which they marked as secrets."""
    r = random.Random(12)
    words = ["garden", "window", "summer", "yellow", "market", "bridge", "winter", "silver", "straße", "fenêtre"]
    docs, truth = [], {}
    for i in range(420):
        real, webhook = token(r, 20, "abcdefghjkmnpqrstuvwxyz23456789"), token(r, 24, "ABCDEFGHJKLMNPQRSTUVWXYZ")
        fake = r.choice(words[:8]) + r.choice(words[:8]) + str(r.randrange(1000, 9999))
        request = token(r, 24, "0123456789")
        truth |= {real: 1, webhook: 1, fake: 0, request: 0}
        prose = " ".join(r.choice(words) for _ in range(30))
        docs.append((i, f"{prose} password={real} {prose} password={fake} hook {webhook} and request {request} end", "x"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, label string")
    findings = spark.createDataFrame(list(truth.items()), "candidate string, label int")
    return frame, findings, truth


def test_the_forest_learns_what_the_rule_gets_wrong(reviewed):
    frame, findings, truth = reviewed
    got = secrets.scan(frame, findings=findings, learn_from=F.expr(FOLD))
    assert "Python" not in got._jdf.queryExecution().toString()
    held = [x for x in got.collect() if x.doc_id % 3 == 0]
    assert len(held) == 4 * 140
    right = [x.is_secret == (truth[x.candidate] == 1) for x in held]
    assert sum(right) / len(right) > 0.97
    # the rule keeps the placeholders and misses the webhook keys
    found = secrets.features(secrets.candidates(frame.withColumn("path", F.lit(""))), ["garden"])
    rule = {x.candidate: x.r for x in found.withColumn("r", secrets.known_secret()).collect()}
    wrong = {x.candidate for x in held if rule[x.candidate] != (truth[x.candidate] == 1)}
    assert len(wrong) > 200
    mended = [x.is_secret == (truth[x.candidate] == 1) for x in held if x.candidate in wrong]
    assert sum(mended) / len(mended) > 0.95


def test_odd_findings(reviewed):
    """Nulls, contradictions, findings that no text holds, of one kind alone, none at all."""
    frame, findings, truth = reviewed
    some = frame.limit(60)
    odd = findings.union(findings.sparkSession.createDataFrame([(None, 1), ("nowhere", 1), ("x", None)], "candidate string, label int"))
    assert secrets.scan(some, findings=odd.union(findings)).count() == 240
    for few in (findings.limit(0), findings.where("label = 1")):
        got = secrets.scan(some, findings=few).collect()
        assert {x.score for x in got} == {0.0, 1.0} and len(got) == 240
    clashing = some.withColumns({"candidate": F.lit(1), "score": F.lit("s"), "named": F.lit(True)})
    assert secrets.scan(clashing.union(clashing), findings=findings).count() == 480


def test_gates_can_be_switched_off(make_docs):
    docs = make_docs([(1, "der Donaudampfschifffahrt und kurz9x", None, None)]).select("doc_id", "text", F.lit("").alias("path"))
    names = lambda **how: sorted(x.candidate for x in secrets.candidates(docs, **how).collect())
    assert names() == []
    assert names(plain=True) == ["Donaudampfschifffahrt"]
    assert names(least=5) == ["kurz9x"]
    assert names(least=3, plain=True) == ["Donaudampfschifffahrt", "der", "kurz9x", "und"]


def test_the_dictionary_has_any_letters(make_docs):
    docs = make_docs([(1, "straße straße über été 12ab CAPS ok", None, None), (2, None, None, None)])
    assert secrets.dictionary(docs) == ["straße", "été", "über"] and secrets.dictionary(docs, 1) == ["straße"]
    assert secrets.dictionary(docs.limit(0)) == []
