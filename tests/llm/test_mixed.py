"""The documents of the mix stage, source by source, against the targets."""

from __future__ import annotations

import random
from collections import Counter

from reference import targets

from transitlens.llm import mixing


def hot_rows(seed=5, n=600):
    """A hot source of texts of 1 to 4000 words, two smaller ones, one of null name."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["a"] * 12 + ["b"] * 4 + ["c"] * 3 + [None])
        words = int(10 ** r.uniform(0, 3.6))
        rows.append((i, " ".join(f"w{r.randrange(5000)}" for _ in range(words)), "en", source))
    return rows


def words(rows):
    out: Counter = Counter()
    for _, text, _, source in rows:
        out[source] += len(text.split())
    return out


def test_mixed_meets_targets_with_a_hot_source_and_long_texts(make_docs):
    rows = hot_rows()
    docs = make_docs(rows)
    source = words(rows)
    goal = targets(source)
    rate = {s: goal[s] / source[s] for s in goal}
    assert rate["a"] < 0.35
    out = [(r.doc_id, r.text, r.lang, r.source) for r in mixing.mixed(docs).collect()]
    got = words(out)
    longest = max(len(t.split()) for _, t, _, _ in rows)
    for s in goal:
        assert abs(got[s] - goal[s]) <= 1.25 * longest, (s, got[s], goal[s])
    # every length at the rate of its source
    for s in ("a", "b", "c"):
        for low in (100, 1000):
            part = lambda xs: words([x for x in xs if x[3] == s and len(x[1].split()) >= low])[s]  # noqa: B023, E731
            assert abs(part(out) - rate[s] * part(rows)) <= 1.25 * longest, (s, low)
    copies = Counter(i for i, *_ in out)
    assert max(copies.values()) <= mixing.MOST
    again = Counter(r.doc_id for r in mixing.mixed(docs.repartition(7)).collect())
    assert again == copies


def test_mixed_spreads_copies_over_repeated_rows(spark):
    text = "one two three four five"
    rows = [(None, text, "a", f"n{i}") for i in range(30)] + [(i, "x y z", "b", "") for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, "u v w x", "c", "")], "doc_id long, text string, source string, note string")
    goal = targets({"a": 150, "b": 180, "c": 4})
    got = mixing.mixed(docs).collect()
    by = Counter(r.source for r in got)
    for s, size in (("a", 5), ("b", 3), ("c", 4)):
        assert abs(by[s] * size - goal[s]) <= size, s
    notes = Counter(r.note for r in got if r.source == "a")
    assert max(notes.values()) - min([notes[f"n{i}"] for i in range(30)]) <= 1
