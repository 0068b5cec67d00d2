"""Pseudobulk sums over files that keep arriving.

A stream carries packed rows (cell_id, target_gene, idx, val), because a cell's total must be known
before its entries are scaled, and a second streaming aggregation cannot follow the first. Sums are
commutative, so the state is one row per (label, gene), however many cells have passed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import CONTROL
from pertmatrix.sources.published import latest, publish

PACKED_SCHEMA = "cell_id bigint, target_gene string, idx array<bigint>, val array<double>, source_ord int"
SUMS = ("count_sum", "cpm_sum", "cpm_sq_sum")


def read_packed(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(PACKED_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def packed_entries(rows: DataFrame) -> DataFrame:
    """target_gene, gene_pos, value, cpm: row-local scaling. A row without counts gives nothing."""
    total = F.aggregate("val", F.lit(0.0), lambda a, v: a + v)
    scaled = F.transform(
        F.arrays_zip("idx", "val"),
        lambda e: F.struct(e.idx.alias("gene_pos"), e.val.alias("value"), (e.val / F.col("_lib") * 1e6).alias("cpm")),
    )
    return rows.withColumn("_lib", total).filter("_lib > 0").select("target_gene", F.inline(scaled))


def sums(entries: DataFrame) -> DataFrame:
    """One grouping; it is the whole state of the stream."""
    return entries.groupBy("target_gene", "gene_pos").agg(
        F.sum("value").alias("count_sum"), F.sum("cpm").alias("cpm_sum"), F.sum(F.col("cpm") * F.col("cpm")).alias("cpm_sq_sum")
    )


def control_once(rows: DataFrame, control: str = CONTROL) -> DataFrame:
    """Control cells of the first source only, as later sources repeat them; the rule of the batch operator, without state."""
    return rows.filter((F.col("target_gene") != control) | (F.col("source_ord") == 0))


def keep_labels(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """Stream-static semi join with a label list."""
    return rows.join(keep.select(F.col(keep.columns[0]).alias("target_gene")), "target_gene", "left_semi")


def _run(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


KEYS = ("target_gene", "gene_pos")
DELTA_SCHEMA = "target_gene string, gene_pos bigint, count_sum double, cpm_sum double, cpm_sq_sum double"
#: Closed batches that a reader may meet beside the base before they are merged into a new one.
COMPACT_EVERY = 16


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*SUMS), "batch_id").alias("_s")).select(*KEYS, "_s.*")


@dataclass(frozen=True)
class BatchLog:
    """What micro-batches have written, and a base that stands for all batches up to its mark.

    A batch lies in a folder of its own, so one that runs again replaces itself. Only closed batches, those before the
    one that is running, are merged into a base; a pointer with the mark publishes it as one step, and readers leave out
    batches up to the mark. So a batch counts once, whatever is run again, and a reader meets the base and
    ``every`` batches or so, however many there have been. ``merge`` makes one row a key of (keys, sums, batch_id).
    """

    spark: SparkSession
    out: str
    merge: Callable[[DataFrame], DataFrame]
    every: int = COMPACT_EVERY

    def write(self, df: DataFrame, batch_id: int) -> None:
        df.select(*KEYS, *SUMS).write.mode("overwrite").parquet(f"{self.out}/batches/batch_id={batch_id}")
        base = latest(self.spark, self.out)
        if batch_id - 1 - (-1 if base is None else base[0]) >= self.every:
            self.compact(batch_id - 1)

    def rows(self, upto: int | None = None) -> DataFrame:
        """Rows of the base, under its mark, and of later batches, up to one of them."""
        batches = self.spark.read.schema(f"{DELTA_SCHEMA}, batch_id bigint").parquet(f"{self.out}/batches")
        if upto is not None:
            batches = batches.filter(F.col("batch_id") <= upto)
        base = latest(self.spark, self.out)
        if base is None:
            return batches
        old = self.spark.read.schema(DELTA_SCHEMA).parquet(base[1]).withColumn("batch_id", F.lit(base[0]).cast("bigint"))
        return batches.filter(F.col("batch_id") > base[0]).unionByName(old)

    def read(self) -> DataFrame:
        return self.merge(self.rows())

    def compact(self, upto: int) -> None:
        """Merge all batches up to ``upto``, which must be closed, into a new base."""
        folder = f"{self.out}/base-{uuid.uuid4().hex}"
        self.merge(self.rows(upto)).write.parquet(folder)
        publish(self.spark, self.out, upto, folder)


def run_running_sums(rows: DataFrame, out: str, checkpoint: str, every: int = COMPACT_EVERY) -> DataFrame:
    """Process what has arrived. A batch writes the new totals of the labels and genes it has changed, under its
    number; the newest of a key counts. So a batch costs what it brings, not all there is.
    """
    log = BatchLog(rows.sparkSession, out, _newest, every)
    _run(sums(packed_entries(rows)), "update", log.write, checkpoint)
    return log.read()


def run_folded_sums(rows: DataFrame, out: str, checkpoint: str, every: int = COMPACT_EVERY) -> DataFrame:
    """Each micro-batch writes its own partial sums under its number; the state is their total."""
    log = BatchLog(rows.sparkSession, out, _added, every)
    _run(rows, "append", lambda df, batch_id: log.write(sums(packed_entries(df)), batch_id), checkpoint)
    return log.read()
