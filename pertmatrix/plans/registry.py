"""Registered queries: a Spark callable (spark, sf_dir) and, where possible, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CELLS = """cells AS (
  SELECT o_orderkey AS cell_id, o_orderkey AS cell_ord,
         CASE WHEN o_custkey % 26 = 0 THEN 'non-targeting' ELSE 'Brand#' || (o_custkey % 26) END AS target_gene,
         o_orderpriority AS context, o_orderstatus AS batch
  FROM orders)"""
GENES = """genes AS (
  SELECT CAST(regexp_extract(gene, '([0-9]+)', 1) AS BIGINT) - 1 AS gene_pos, gene,
         'ENSG' || lpad(regexp_extract(gene, '([0-9]+)', 1), 11, '0') AS ensembl_id
  FROM (SELECT DISTINCT p_brand AS gene FROM part) b)"""
EXPR = """expr AS (
  SELECT l_orderkey AS cell_id, p_brand AS gene, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
LIB = "lib AS (SELECT cell_id, sum(value) AS libsize FROM expr GROUP BY 1)"
ENTRIES = "entries AS (SELECT e.*, libsize, target_gene, context, batch FROM expr e JOIN lib USING (cell_id) JOIN cells USING (cell_id))"
LOGGED = "logged AS (SELECT * REPLACE (ln(1 + value / libsize * 1e4) AS value) FROM entries)"
MATRIX = ",\n".join([CELLS, GENES, EXPR, LIB, ENTRIES])
MATRIX_LOG = MATRIX + ",\n" + LOGGED


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its key with its oracle."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col: str | Column, scale: float = 1.0) -> Column:
    """Rounded to six places after scaling to order 1, without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c / scale if scale != 1.0 else c, 6) + F.lit(0.0)
