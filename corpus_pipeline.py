"""The corpus pipeline: quality rules, near-dedup, secret scans, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), where docs are the documents the stage before has kept, and returns a
DataFrame; ``run`` writes it as Parquet and rereads it as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.llm import bpe, near_dup, quality, secrets
from pertmatrix.llm.common import table
from pertmatrix.llm.queries import mix_documents
from pertmatrix.session import materialized


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose votes speak for them."""
    return quality.judge_quality(docs).where("_q_kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8); rows with the same id are one, of which the longest text stays."""
    judged = materialized(near_dup.near_duplicates(docs, width=5, percent=80), "pipeline-kept")
    kept = judged.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    whole = F.struct(*docs.columns)
    named = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(whole, F.struct(F.length("text"), "text")).alias("_row")).select("_row.*")
    return named.unionByName(docs.where("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced; n_chars follows the text."""
    found = secrets.scan(docs, column="_findings")
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("_findings")))
    return clean.withColumn("n_chars", F.when(F.exists("_findings", lambda x: x["secret"]), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens by source, language and topic match the tempered shares."""
    return mix_documents(docs, F.col("source"), F.col("lang")).where("_m_kept").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("secret scans", secret_scan), ("mixing", mix_sources), ("byte-level BPE", byte_bpe)]

#: Expectation-maximisation and forests are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
