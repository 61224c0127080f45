"""The language sample where one text is very long, and where a language has little of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from transitlens.llm import langid

SF = "/root/testdata/sf0.01"


def test_every_sampled_text_has_its_share(make_docs):
    long = " ".join(f"lang{i}" for i in range(20_000))
    docs = make_docs([(i, long if i % 2 else f"only{i} here", "en", "a") for i in range(40)])
    got = langid.learn(docs, F.lit(True))["en"]
    assert len(got) <= langid.SAMPLE_CHARS + 2 and len(got) > 0.95 * langid.SAMPLE_CHARS
    assert all(f" only{i} here " in got for i in range(0, 40, 2)) and got.count(" lang0 ") == 20


@pytest.mark.parametrize("chars", [5, 30, 100, 10_000])
def test_shares_are_refilled(chars):
    parts = ["a bc", "", "d" * 50, "e f " * 30 + "g"]
    got = langid._share(parts, chars)
    assert len(got) <= chars and got.strip()
    if chars == 10_000:
        assert got == " ".join(p for p in parts if p)


def test_a_rare_language_is_not_taken_for_others(spark):
    """One labelled text of one language, all of the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL AND n_chars > 200")
    rare = docs.groupBy("lang").count().orderBy("count", "lang").first().lang
    held = langid.held_out_rows()
    one = docs.where((F.col("lang") == rare) & ~held).orderBy("doc_id").limit(1).withColumn("text", F.substring("text", 1, 400))
    some = docs.where((F.col("lang") != rare) | held).unionByName(one)
    got = langid.identify(some).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    for lang in {r.lang for r in got}:
        of = [r.lang_pred == lang for r in got if r.lang == lang]
        assert sum(of) / len(of) > 0.97, (lang, sum(of), len(of))
