from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, row string, score string"


@pytest.fixture
def make_docs(spark):
    """Documents with extra columns whose names clash with those the operators use."""

    def make(rows):
        full = [(i, t, lang, src, len(t or ""), "x", "y", "z") for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return make


PROSE = "The quick brown fox jumps over the lazy dog while seven wizards mix a potion near the old mill"


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and blank texts, no letters, ties, repeated rows, a very long text."""
    long = " ".join(f"word{i % 977} {i}" for i in range(60_000)) + " " + "x" * 400_000
    return make_docs(
        [
            (1, PROSE, "en", "a"),
            (2, PROSE, "en", "b"),
            (2, PROSE, "en", "b"),
            (3, PROSE + " today", None, None),
            (4, "", "en", "a"),
            (5, None, "de", None),
            (6, " \t\n", "de", "c"),
            (7, "12345 !!", "en", "a"),
            (None, "Ein kurzer Satz über Äpfel", "de", "a"),
            (None, None, None, None),
            (8, long, "en", "c"),
            (9, "two words", "en", "é"),
            (9, "other words", "en", "é"),
            (10, "a\x00b <|endoftext|> ß 日本", "en", "c"),
        ]
    )


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])
