"""The registered queries against SQL, and the pipeline against its own stages."""

import hashlib

import oracle
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from pertmatrix.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, SF, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_judges_every_document(spark, name):
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert {*queries.QUERIES, "pipeline"} <= set(entry_points.queries())


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    kept = [{r["doc_id"] for r in x.collect()} for x in seen]
    assert all(b <= a for a, b in zip(kept, kept[1:])) and kept[2] == kept[3] and kept[-1]
    last = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()}
    for r in seen[-1].collect():
        assert last[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
        assert "AKIA" not in r["text"] and r["n_chars"] == len(r["text"])
