"""Readers. A missing path raises when the reader is called."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import MAX_AXIS, CountMatrix
from pertmatrix.operators.manifest import spdx

CELLS_SCHEMA = "cell_id bigint, cell_ord bigint, target_gene string, context string, batch string"
GENES_SCHEMA = "gene_pos bigint, gene string, ensembl_id string"
ROWS_SCHEMA = "libsize double, entries array<struct<gene:string,value:double>>"
EXPR_SCHEMA = "cell_id bigint, gene string, value double"

HOST_RECORD_SCHEMA = (
    "id string, doi string, conceptdoi string, "
    "metadata struct<title:string, version:string, license:struct<id:string>>, "
    "files array<struct<key:string, size:bigint, checksum:string, links:struct<self:string>>>"
)


def scan_matrix(spark: SparkSession, path: str) -> CountMatrix:
    """A matrix saved by :func:`pertmatrix.sources.sinks.write_matrix`. Columns are read as used."""
    return CountMatrix(
        spark.read.schema(CELLS_SCHEMA).parquet(f"{path}/cells"),
        spark.read.schema(GENES_SCHEMA).parquet(f"{path}/genes"),
        spark.read.schema(EXPR_SCHEMA).parquet(f"{path}/expr"),
    )


def scan_packed(spark: SparkSession, path: str) -> CountMatrix:
    """A matrix saved by :func:`pertmatrix.sources.sinks.write_packed`; reading cells or totals reads no entries."""
    rows = spark.read.schema(f"{CELLS_SCHEMA}, {ROWS_SCHEMA}").parquet(f"{path}/rows")
    genes = spark.read.schema(GENES_SCHEMA).parquet(f"{path}/genes")
    return CountMatrix(rows.drop("libsize", "entries"), genes, rows.select("cell_id", F.inline("entries")), rows)


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Cell table only; no value is read."""
    return spark.read.schema(CELLS_SCHEMA).parquet(f"{path}/cells")


def scan_label_list(spark: SparkSession, path: str, column: str = "target_gene") -> DataFrame:
    """Distinct labels of a CSV with a header: the named column if it exists, else the first."""
    rows = spark.read.csv(path, header=True)
    chosen = column if column in rows.columns else rows.columns[0]
    return rows.select(F.col(chosen).cast("string").alias(column)).distinct()


def first_labels(labels: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first n labels in list order."""
    return labels.orderBy(order).limit(n)


def scan_gene_axis(spark: SparkSession, path: str, expected: int) -> tuple[DataFrame, bool]:
    """(gene_pos, gene) of a one-column list, and whether it has a header row.

    The list is read both ways; the reading whose row count equals ``expected`` is right. A list in
    several files is read in the order of their names, and may have a header in the first.
    """
    lines = spark.read.text(path).filter("value != ''")
    n = lines.count()
    if n not in (expected, expected + 1) or expected > MAX_AXIS:
        raise ValueError(f"gene list has {n} lines, expected {expected} genes with or without a header")
    header = n == expected + 1
    # the axis is a checked, small list: one task may number it, by file name, place in the file, and line
    numbered = lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.split("value", ",")[0].alias("gene"),
    )
    pos = F.expr("row_number() over (order by _file, _start, _id)").cast("bigint") - (2 if header else 1)
    return numbered.select(pos.alias("gene_pos"), "gene").filter("gene_pos >= 0"), header


def scan_source_set(sources: Mapping[str, tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """Cells of many sources with a ``source`` column, and (source, control_label)."""
    parts = [df.withColumn("source", F.lit(name)) for name, (df, _) in sources.items()]
    cells = reduce(DataFrame.unionByName, parts)
    dims = [(name, control) for name, (_, control) in sources.items()]
    return cells, cells.sparkSession.createDataFrame(dims, "source string, control_label string")


def parse_source_specs(specs: Sequence[str], default_control: str = "control") -> list[tuple[str, str]]:
    """(path, control label) of 'path:control_label' texts; without a label the default applies."""
    out = []
    for spec in specs:
        path, colon, control = spec.rpartition(":")
        labelled = colon and "/" not in control  # a colon inside a URL is not a label
        out.append((path, control or default_control) if labelled else (spec, default_control))
    return out


def scan_host_records(responses: DataFrame, host: str, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(records, files) from saved host API responses, one JSON text per row.

    records: host, record_id, title, version, doi, license. files: record_id, name, size_bytes,
    checksum, url.
    """
    r = responses.select(F.from_json(column, HOST_RECORD_SCHEMA).alias("r")).select("r.*")
    records = r.select(
        F.lit(host).alias("host"), F.col("id").alias("record_id"), F.coalesce("metadata.title", F.lit("")).alias("title"),
        F.col("metadata.version").alias("version"), "doi", spdx(F.col("metadata.license.id")).alias("license"),
    )
    files = r.select(F.col("id").alias("record_id"), F.inline("files")).select(
        "record_id", F.col("key").alias("name"), F.col("size").alias("size_bytes"), "checksum",
        F.coalesce("links.self", F.lit("")).alias("url"),
    )
    return records, files


def scan_saved(spark: SparkSession, path: str) -> DataFrame:
    """A result saved earlier, such as the real side's rank tests. Raises when it is not there."""
    return spark.read.parquet(path)
