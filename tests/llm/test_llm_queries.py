"""The registered queries and the pipeline."""

from __future__ import annotations

import pytest
from oracle import compare, duck

import corpus_pipeline
from transitlens.llm import queries

NAMES = sorted(queries.queries())


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__

    assert {n.split("_")[0] for n in NAMES} == {f"op{i}" for i in range(1, 14)}
    assert set(__spark_entry__.queries()) == {*__spark_entry__.ping_queries(), *NAMES, "pipeline"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    ok, why = compare(queries.queries()[name](spark, sf_dir), duck(sf_dir), queries.oracle_sql()[name])
    assert ok, why


def test_pipeline_stages(spark, odd_docs, no_docs):
    sf_dir = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "decontamination", "source_mix", "shards"]
    for docs in (odd_docs, no_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        columns = docs.columns
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert out.columns == columns + (["shard", "slot"] if i == 4 else []), name
            docs = out
