"""Queries: incremental sums. Each equals its batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import pack_rows
from pertmatrix.plans.q_sources import PB_SQL
from pertmatrix.plans.registry import MATRIX, query, r6
from pertmatrix.session import scratch_path
from pertmatrix.sources import testdata as T
from pertmatrix.streaming import incremental as I

BATCH = f"""WITH {MATRIX}, {PB_SQL}
SELECT target_gene, gene_pos, count_sum, round(cpm_sum / 1e6, 6) + 0.0 AS cpm_sum, round(cpm_sq_sum / 1e12, 6) + 0.0 AS cpm_sq_sum FROM pb JOIN genes USING (gene)"""


def packed(spark: SparkSession, d: str) -> DataFrame:
    """One sparse row per nonempty cell, with its label and batch."""
    m = T.count_matrix(spark, d)
    return pack_rows(m).join(m.cells.select("cell_id", "target_gene", "batch"), "cell_id").select("cell_id", "target_gene", "idx", "val", "batch")


def arrived(rows: DataFrame, name: str) -> str:
    """Rows as files that a stream picks up one by one."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    kept = rows.drop("batch")
    if "source_ord" not in kept.columns:
        kept = kept.withColumn("source_ord", F.lit(0))
    kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell_id").write.parquet(path)
    return path


def stream_of(rows: DataFrame) -> DataFrame:
    """The rows as a stream of two micro-batches, however many files there are."""
    spark = rows.sparkSession
    path = arrived(rows, "stream-in")
    return I.read_packed(spark, path, max(1, -(-len(spark.read.parquet(path).inputFiles()) // 2)))


def shown(sums: DataFrame) -> DataFrame:
    return sums.select("target_gene", "gene_pos", "count_sum", r6("cpm_sum", 1e6).alias("cpm_sum"), r6("cpm_sq_sum", 1e12).alias("cpm_sq_sum"))


@query("stream_pb_sums", BATCH)
def stream_pb_sums(spark, d):
    rows = stream_of(packed(spark, d))
    return shown(I.run_running_sums(rows, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")))


@query("stream_pb_merge", BATCH)
def stream_pb_merge(spark, d):
    rows = stream_of(packed(spark, d))
    return shown(I.run_folded_sums(rows, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")))


@query("stream_control_once", BATCH)
def stream_control_once(spark, d):
    """Finished orders and the others arrive as two deliveries; both repeat every control cell."""
    rows = packed(spark, d)
    control, finished = F.col("target_gene") == "non-targeting", F.col("batch") == "F"
    both = rows.filter(control | finished).withColumn("source_ord", F.lit(0)).unionByName(rows.filter(control | ~finished).withColumn("source_ord", F.lit(1)))
    stream = I.control_once(stream_of(both))
    return shown(I.run_running_sums(stream, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")))


@query("stream_filter_static_keep", BATCH + " WHERE target_gene IN (SELECT 'Brand#' || c_nationkey FROM customer)")
def stream_filter_static_keep(spark, d):
    keep = T.table(spark, d, "customer").select(F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string"))).distinct()
    stream = I.keep_labels(stream_of(packed(spark, d)), keep)
    return shown(I.run_running_sums(stream, scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")))
