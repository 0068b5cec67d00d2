"""Tables that are published as one step: a small pointer row, written last, names the folder that counts.

Readers follow the latest pointer, so they never meet a half-written or half-replaced table, and a writer that is lost
before its pointer leaves only a folder that nobody reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import axis_lookup
from pertmatrix.operators import manifest as M
from pertmatrix.operators.contract import Contract, completeness_violations, contract_violations, require_none, value_violations

POINTER_SCHEMA = "version bigint, folder string"


def _pointers(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(POINTER_SCHEMA).parquet(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(version, folder) of the latest publication, None before the first."""
    pointers = _pointers(spark, path)
    row = None if pointers is None else pointers.agg(F.max_by(F.struct("version", "folder"), "version").alias("p")).first()["p"]
    return None if row is None else (row["version"], row["folder"])


def publish(spark: SparkSession, path: str, version: int, folder: str) -> None:
    """Let ``folder`` count as ``version``, which must be higher than all before."""
    spark.createDataFrame([(version, folder)], POINTER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/published")


# -- predictions -----------------------------------------------------------------------------


def publish_prediction(contract: Contract, cells: DataFrame, entries: DataFrame, path: str) -> str:
    """Stage the packed rows, check the contract on what was written, then publish; the folder that now counts.

    ``cells``: cell_id, context, target_gene. ``entries``: cell_id, gene, value. Explicit zeros are dropped. The emission
    behind both runs once: all checks read the staged rows. A flaw raises, and nothing is published. Entries of unknown
    genes or cells are staged as well, so the checks see them.
    """
    spark = cells.sparkSession
    require_none(contract_violations(contract))
    folder = f"{path}/staged-{uuid.uuid4().hex}"
    axis = axis_lookup(contract.genes).withColumnRenamed("gene_pos", "idx")
    known = entries.filter("value IS NULL OR value != 0 OR isnan(value)").join(axis, "gene", "left")
    stored = known.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("idx", F.lit(-1)).alias("idx"), F.col("value").cast("float").alias("val")))).alias("e"))
    rows = cells.select("cell_id", "context", "target_gene", F.lit(True).alias("_cell")).join(stored, "cell_id", "full").select(
        "cell_id", "context", "target_gene", F.coalesce("_cell", F.lit(False)).alias("homed"),
        F.coalesce("e.idx", F.array().cast("array<bigint>")).alias("idx"), F.coalesce("e.val", F.array().cast("array<float>")).alias("val"),
    )
    rows.hint("rebalance", "context", "target_gene").write.partitionBy("context", "target_gene").parquet(folder)

    kinds = dict(rows.dtypes)
    staged = spark.read.schema(", ".join(f"{c} {t}" for c, t in kinds.items())).parquet(folder)
    written = staged.filter("homed").select("cell_id", "context", "target_gene")
    each = staged.select("cell_id", F.inline(F.arrays_zip(F.col("idx"), F.col("val").alias("value"))))
    names = axis_lookup(contract.genes).withColumnRenamed("gene_pos", "idx")
    found = each.join(names, "idx", "left").select("cell_id", F.coalesce("gene", F.lit("")).alias("gene"), F.col("value").cast("double").alias("value"))
    require_none(value_violations(contract, written, found).unionByName(completeness_violations(contract, written)))
    before = latest(spark, path)
    publish(spark, path, 0 if before is None else before[0] + 1, folder)
    return folder


def read_prediction(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, context, target_gene, idx, val of the latest published prediction."""
    now = latest(spark, path)
    if now is None:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(now[1]).drop("homed")


# -- provenance ------------------------------------------------------------------------------


class ProvenanceChanged(ValueError):
    """The host's record is not the recorded one, and no refresh was asked for."""


@dataclass(frozen=True)
class ProvenanceLog:
    """Versions of a manifest: ``records`` (record_id, license, version, ...) and ``files`` (record_id, name, size_bytes, checksum, ...).

    Versions are only ever added. Both tables of a version lie in one folder and are published by one pointer.
    """

    spark: SparkSession
    path: str

    def current(self) -> tuple[DataFrame, DataFrame] | None:
        now = latest(self.spark, self.path)
        return None if now is None else (self.spark.read.parquet(f"{now[1]}/records"), self.spark.read.parquet(f"{now[1]}/files"))

    def changes(self, records: DataFrame, files: DataFrame) -> DataFrame:
        """record_id, name, change: files that differ from the latest version, and records by field, added and removed ones included.

        The date of retrieval and other columns are not compared.
        """
        was_records, was_files = self.current()
        of_files = M.manifest_diff(was_files, files).select("record_id", "name", "change")
        of_fields = M.record_diff(was_records, records).select("record_id", F.lit(None).cast("string").alias("name"), F.col("field").alias("change"))
        was, now = (x.select("record_id").distinct() for x in (was_records, records))
        gone = was.join(now, "record_id", "left_anti").withColumn("change", F.lit("record removed"))
        new = now.join(was, "record_id", "left_anti").withColumn("change", F.lit("record added"))
        of_records = gone.unionByName(new).select("record_id", F.lit(None).cast("string").alias("name"), "change")
        return of_files.unionByName(of_fields).unionByName(of_records)

    def record(self, records: DataFrame, files: DataFrame, *, refresh: bool = False) -> str:
        """written, same or refreshed: the manifest is written before data, once, and again only for a refresh that changes it.

        A changed record without a refresh raises ProvenanceChanged and leaves the log as it was.
        """
        now = latest(self.spark, self.path)
        if now is not None:
            counts = self.changes(records, files).groupBy("change").agg(F.count("*").alias("n")).orderBy("change").collect()
            if not counts:
                return "same"
            if not refresh:
                raise ProvenanceChanged("; ".join(f"{r['change']} ({r['n']})" for r in counts))
        folder = f"{self.path}/version-{uuid.uuid4().hex}"
        records.write.parquet(f"{folder}/records")
        files.write.parquet(f"{folder}/files")
        publish(self.spark, self.path, 0 if now is None else now[0] + 1, folder)
        return "written" if now is None else "refreshed"
