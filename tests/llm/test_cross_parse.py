"""The cross-parse of whole texts against a plain one, phrase by phrase."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from transitlens.llm import kernels as K, langid


def plain_text(text):
    """Words in lower case (A-Z) with single gaps around them, as bytes."""
    raw = re.sub(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", b" ", (text or "").encode())
    return b" " + raw.lower().strip(b" ") + b" " if raw.strip(b" ") else b" "


def plain_phrases(text: bytes, sample: bytes) -> int:
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size] in sample and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def some_text(r, words):
    return "".join(r.choice(words) + r.choice([" ", ", ", "\n\n", "-", " (", "."]) for _ in range(r.randint(0, 60)))


@pytest.fixture
def texts():
    r = random.Random(3)
    words = ["the", "Then", "there", "other", "über", "Äpfel", "z9", "9", "x" * 40, "日本", "a"]
    return [some_text(r, words) for _ in range(120)] + ["", " ", "!!", "Q", "the", None, "\x00the\x00"]


def test_texts_are_spoken_alike(texts):
    byte, offsets = langid.spoken(*K.buffers(pa.array(texts, pa.string())))
    got = [byte[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == [plain_text(t) for t in texts]


def test_phrases_run_over_gaps_and_equal_a_plain_parse(texts):
    r = random.Random(4)
    samples = [some_text(r, ws) * 2 for ws in (["the", "there", "other"], ["über", "äpfel", "the"], ["q"], ["zzz", "9"])]
    samples = [plain_text(s) for s in samples]
    parser = langid.Parser(samples)
    byte, offsets = langid.spoken(*K.buffers(pa.array(texts, pa.string())))
    want = np.array([[plain_phrases(plain_text(t), s) for s in samples] for t in texts])
    assert (parser.phrases(byte, offsets, 1 << 20) == want).all()
    for chunk in (1, 7, 64):
        cut = parser.phrases(byte, offsets, chunk)
        parts = -(-np.diff(offsets) // chunk)
        assert (cut >= want).all() and (cut - want <= (parts - 1)[:, None]).all()


def test_query_equals_a_plain_parse(spark, make_docs):
    """Predicted language and entropy of every row of a small table; texts of less than a chunk."""
    r = random.Random(5)
    vocabulary = {"aa": ["ban", "bana", "nab", "anna"], "bb": ["kolo", "loko", "okol", "kol"], "cc": ["ban", "kolo", "zim"]}
    rows = [(i, some_text(r, vocabulary[lang]), lang, "s") for i, lang in enumerate(random.Random(6).choices(list(vocabulary), k=90))]
    docs = make_docs(rows + [(200, None, "aa", "s"), (201, "12 34", "aa", "s")])
    held = F.col("doc_id") >= 60
    sample = {k: v.encode() for k, v in langid.learn(docs, ~held).items()}
    assert list(sample) == ["aa", "bb", "cc"]
    for x in langid.identify(docs, held_out=held).collect():
        text = plain_text(dict((i, t) for i, t, _, _ in rows).get(x.doc_id, "12 34" if x.doc_id == 201 else None))
        if not re.search(rb"[a-z]", text):
            assert (x.lang_pred, x.score, x.phrases_per_byte) == ("und", 0.0, 0.0)
            continue
        n = {lang: plain_phrases(text, s) for lang, s in sample.items()}
        spent = {lang: n[lang] * np.log2(len(s)) for lang, s in sample.items()}
        best = min(spent, key=lambda lang: (spent[lang], lang))
        assert x.lang_pred == best
        assert x.phrases_per_byte == n[best] / len(text.replace(b" ", b""))
        assert x.score == pytest.approx(1 / spent[best] / sum(1 / v for v in spent.values()))


def test_many_languages_share_a_bound(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_CHARS", 3000)
    docs = make_docs([(i, f"lang{i % 30} " * 4000, f"l{i % 30:02d}", "s") for i in range(60)])
    sample = langid.learn(docs, F.lit(True))
    assert len(sample) == 30 and sum(len(t) for t in sample.values()) <= 3000 + 2 * 30
    assert langid.Parser([t.encode() for t in sample.values()]).table.nbytes < 4 * 2 * 3200 * 32
