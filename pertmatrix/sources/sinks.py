"""Writers. All of them write distributed, partitioned where readers prune.

Partitioned writes are rebalanced by their keys: adaptive execution splits the partition of a hot
label over several tasks and joins those of small labels, so files are neither few and huge nor many
and tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import CountMatrix, axis_lookup, packed_cells
from pertmatrix.operators.contract import (
    Contract, completeness_violations, contract_violations, require_none, value_violations,
)
from pertmatrix.operators.pseudobulk import PseudobulkSums


def write_matrix(matrix: CountMatrix, path: str) -> str:
    matrix.cells.write.mode("errorifexists").parquet(f"{path}/cells")
    matrix.genes.write.mode("errorifexists").parquet(f"{path}/genes")
    matrix.expr.write.mode("errorifexists").parquet(f"{path}/expr")
    return path


def write_packed(matrix: CountMatrix, path: str) -> str:
    """The matrix with one packed row per cell: its only shuffle by cell, before the passes over it."""
    rows = matrix.rows if matrix.rows is not None else packed_cells(matrix.cells, matrix.expr)
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    matrix.genes.write.mode("errorifexists").parquet(f"{path}/genes")
    return path


def write_pseudobulk(pb: PseudobulkSums, path: str) -> str:
    pb.gene.write.mode("errorifexists").parquet(f"{path}/pb_gene")
    pb.label.write.mode("errorifexists").parquet(f"{path}/pb_label")
    return path


def read_pseudobulk(spark: SparkSession, path: str, by: tuple[str, ...] = ("target_gene",)) -> PseudobulkSums:
    return PseudobulkSums(spark.read.parquet(f"{path}/pb_gene"), spark.read.parquet(f"{path}/pb_label"), by)


def write_subset(cells: DataFrame, entries: DataFrame, path: str) -> str:
    """Extracted cells with their entries, one folder per label."""
    out = cells.join(entries.select("cell_id", "gene", "value"), "cell_id", "left")
    out.hint("rebalance", "target_gene").write.mode("errorifexists").partitionBy("target_gene").parquet(path)
    return path


def write_prediction(contract: Contract, cells: DataFrame, entries: DataFrame, path: str) -> str:
    """Check the contract, then write one folder per (context, target_gene). Explicit zeros are dropped.

    ``cells``: cell_id, context, target_gene. ``entries``: cell_id, gene, value.
    """
    require_none(contract_violations(contract))
    require_none(value_violations(contract, cells, entries).unionByName(completeness_violations(contract, cells)))
    axis = axis_lookup(contract.genes).withColumnRenamed("gene_pos", "idx")
    stored = entries.filter("value != 0").join(axis, "gene").groupBy("cell_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col("value").cast("float").alias("val")))).alias("e")
    )
    rows = cells.join(stored, "cell_id", "left").select(
        "cell_id", "context", "target_gene",
        F.coalesce("e.idx", F.array().cast("array<bigint>")).alias("idx"),
        F.coalesce("e.val", F.array().cast("array<float>")).alias("val"),
    )
    rows.hint("rebalance", "context", "target_gene").write.mode("errorifexists").partitionBy("context", "target_gene").parquet(path)
    return path


def write_report(df: DataFrame, path: str, fmt: str = "json") -> str:
    """A metrics table as JSON lines or CSV with a header."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown report format {fmt!r}")
    writer = df.write.mode("overwrite")
    (writer.json(path) if fmt == "json" else writer.option("header", True).csv(path))
    return path


def write_provenance(records: DataFrame, files: DataFrame, path: str, *, refresh: bool = False) -> str:
    """Manifest before data, once. A second write fails unless a refresh is asked for."""
    mode = "overwrite" if refresh else "errorifexists"
    records.write.mode(mode).parquet(f"{path}/records")
    files.write.mode(mode).parquet(f"{path}/files")
    return path


def append_snapshot(boards: DataFrame, path: str, stamp: str) -> str:
    """Board rows of one fetch, under the fetch's own folder."""
    boards.withColumn("fetched_utc", F.lit(stamp)).write.mode("append").partitionBy("fetched_utc").parquet(path)
    return path
