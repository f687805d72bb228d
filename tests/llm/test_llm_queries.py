"""Registered queries of the operators, and the pipeline, on the smallest tables."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from trailmine.llm.oracle import oracle_sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SF_DIR), reason="no test tables")


def test_all_operators_are_registered():
    names = entry_points.queries()
    assert [n for i in range(1, 14) for n in names if n.startswith(f"op{i}_")].__len__() == 13
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    want = con.sql(oracle_sql()[name])
    got = entry_points.queries()[name](spark, SF_DIR).select(*want.columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]
    once = corpus_pipeline.drop_exact_copies(spark, docs, SF_DIR)
    assert once.columns == docs.columns
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[" ".join(f" {r['text']} ".split(" "))].append(r["doc_id"])
    result = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert result.groupby("sequence_id").length.sum().max() <= 2048
    assert set(result.doc_id) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
