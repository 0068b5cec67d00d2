"""The given tables read as matrices, edges and manifests (the mapping of FIXTURES.md, part B)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import CONTROL, CountMatrix, packed_cells


#: Lines that one task sums and packs by cell.
LINES_A_TASK = 300_000
#: Parts up to which their join with the lines is left to Spark, which may broadcast them.
FEW_PARTS = 100_000

# The columns in use, stated so that opening a table starts no schema-inference job.
SCHEMAS = {
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a cell."""
    label = F.when(F.col("o_custkey") % 26 == 0, F.lit(CONTROL)).otherwise(
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 26).cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.col("o_orderkey").alias("cell_ord"), label.alias("target_gene"),
        F.col("o_orderpriority").alias("context"), F.col("o_orderstatus").alias("batch"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a gene; its number gives the position and the Ensembl-shaped id."""
    k = F.regexp_extract("gene", r"(\d+)", 1).cast("bigint")
    return (
        table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct()
        .select((k - 1).alias("gene_pos"), "gene", F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0")).alias("ensembl_id"))
    )


def cell_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the lines are dealt over by cell: at most about LINES_A_TASK lines each. Counting reads file footers only."""
    lines = table(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, math.ceil(lines / LINES_A_TASK))


def with_brand(spark: SparkSession, sf_dir: str, line: DataFrame, brand: str) -> DataFrame:
    """Lines with the brand of their part.

    Where the parts are many, each task hashes its share of them, as a merge join would sort the lines, which are many more: adaptive
    execution joins partitions by their compressed bytes, of which a few grow to many in a sort. Counting reads file footers only.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias(brand))
    if part.count() > FEW_PARTS:
        part = part.hint("shuffle_hash")
    return line.join(part, line.l_partkey == part.p_partkey)


def expr(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Summed quantity is the count. Lines meet once by cell and are summed by gene there.

    The number of ``tasks`` is stated, as adaptive execution would join partitions by their compressed bytes, of which a few
    grow to many in the maps and sorts that sum and pack them.
    """
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell_id"), "l_partkey", "l_quantity")
    by_cell = with_brand(spark, sf_dir, line, "gene").select("cell_id", "gene", "l_quantity").repartition(
        tasks or cell_tasks(spark, sf_dir), "cell_id"
    )
    return by_cell.groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("value"))


def count_matrix(spark: SparkSession, sf_dir: str) -> CountMatrix:
    """The three tables, and the packed rows: entries are packed where they are summed."""
    entries = expr(spark, sf_dir, cell_tasks(spark, sf_dir))
    return CountMatrix(cells(spark, sf_dir), genes(spark, sf_dir), entries, packed_cells(cells(spark, sf_dir), entries))


def long_rows(m: CountMatrix) -> DataFrame:
    """part, id, name, other, value: the three tables of a matrix as one, for results that hold them all."""
    none, text = F.lit(None), lambda c: F.col(c).cast("string").alias("id")
    rows = [
        m.cells.select(F.lit("cell").alias("part"), text("cell_id"), F.col("target_gene").alias("name"), F.col("context").alias("other"), none.cast("double").alias("value")),
        m.genes.select(F.lit("gene").alias("part"), text("gene_pos"), F.col("gene").alias("name"), F.col("ensembl_id").alias("other"), none.cast("double").alias("value")),
        m.expr.select(F.lit("entry").alias("part"), text("cell_id"), F.col("gene").alias("name"), none.cast("string").alias("other"), "value"),
    ]
    return reduce(DataFrame.unionByName, rows)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, score, confidence, region: one row per distinct candidate edge and attribute set."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    return (
        with_brand(spark, sf_dir, line, "dst")
        .select(
            F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("src"), "dst",
            F.substring(F.lit("ABCDE"), 1 + F.col("l_linenumber") % 5, F.lit(1)).alias("confidence"),
            F.col("l_returnflag").alias("region"),
        )
        .groupBy("src", "dst", "confidence", "region")
        .agg(F.count("*").alias("score"))
    )


# The licence a record states, by document language; German records state none.
STATED_LICENSE = {"en": "cc-by-4.0", "es": "cc-by-nc-sa-4.0", "fr": "custom-terms", "de": None}


def host_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, name, size_bytes, checksum, url, stated: a document is a file of its source's record."""
    stated = F.lit(None).cast("string")
    for lang, name in STATED_LICENSE.items():
        if name:
            stated = F.when(F.col("lang") == lang, F.lit(name)).otherwise(stated)
    return table(spark, sf_dir, "documents").select(
        F.concat_ws(":", "source", "lang").alias("record_id"),
        F.col("doc_id").cast("string").alias("name"),
        F.col("n_chars").alias("size_bytes"),
        F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("md5:"), F.md5("text"))).alias("checksum"),
        F.concat(F.lit("https://host.example/"), F.col("doc_id").cast("string")).alias("url"),
        stated.alias("stated"),
    )


def contexts(spark: SparkSession, sf_dir: str, most: int = 1000) -> list[str]:
    """The contexts that the cells have; more than ``most`` are refused, as each becomes a branch of a plan."""
    found = [r[0] for r in cells(spark, sf_dir).select("context").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} contexts")
    return sorted(found)
