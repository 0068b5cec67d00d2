"""Queries: prior edges and node features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pertmatrix.operators import axis, edges as E, profile as PR
from pertmatrix.plans.q_joins import ALIGNED, EDGES
from pertmatrix.plans.registry import CELLS, EXPR, GENES, query, r6
from pertmatrix.sources import testdata as T
from pertmatrix.sources.harmonize import harmonize as harmonize_matrix, harmonize_cells

BASE = f"WITH {GENES}, {EDGES}, {ALIGNED}"
COLUMNS = ["src_pos", "dst_pos", "confidence", "region", "score"]


def aligned(spark, d) -> DataFrame:
    return E.align_edges(T.edges(spark, d), axis.gene_index(T.genes(spark, d), "gene"))


@query("edges_align", f"{BASE} SELECT src_pos, dst_pos, confidence, region, score FROM aligned")
def edges_align(spark, d):
    return aligned(spark, d).select(*COLUMNS)


@query("edges_validate", f"""{BASE}, g AS (SELECT count(*) AS n FROM genes)
SELECT 'position out of range' AS rule, count(*) AS n FROM aligned WHERE src_pos >= 20 OR dst_pos >= 20
UNION ALL SELECT 'missing position', count(*) FROM edges LEFT JOIN genes ON src = gene WHERE gene_pos IS NULL""")
def edges_validate(spark, d):
    """The axis is declared five genes short, and sources with an unknown regulator keep a NULL position."""
    index = axis.gene_index(T.genes(spark, d), "gene")
    edges = T.edges(spark, d)
    positions = edges.join(index.select(F.col("gene_id").alias("src"), F.col("gene_pos").alias("src_pos")), "src", "left").join(
        index.select(F.col("gene_id").alias("dst"), F.col("gene_pos").alias("dst_pos")), "dst"
    )
    known, unknown = F.col("src_pos").isNotNull(), F.col("src_pos").isNull()
    return E.edge_violations(positions.filter(known), 20).unionByName(
        E.edge_violations(positions.filter(unknown).withColumn("dst_pos", F.lit(0).cast("bigint")), 20)
    )


@query("node_features_validate", f"""
WITH {GENES}, rows AS (SELECT s_suppkey % 30 AS gene_pos, count(*) AS k FROM supplier GROUP BY 1)
SELECT * FROM (
  SELECT 'gene without exactly one row' AS rule, count(*) AS n FROM genes LEFT JOIN rows USING (gene_pos) WHERE coalesce(k, 0) <> 1
  UNION ALL SELECT 'row for an unknown gene', count(*) FROM rows ANTI JOIN genes USING (gene_pos)) v WHERE n > 0""")
def node_features_validate(spark, d):
    rows = T.table(spark, d, "supplier").select((F.col("s_suppkey") % 30).alias("gene_pos"), F.array("s_acctbal").alias("features"))
    index = axis.gene_index(T.genes(spark, d), "gene")
    return E.feature_violations(rows, index)


@query("edges_union_typed", f"""{BASE}
SELECT 'trans:tf_target:regulators' AS edge_type, src_pos, dst_pos FROM aligned WHERE confidence IN ('A', 'B', 'C')
UNION ALL SELECT 'posttx:binding:sites', src_pos, dst_pos FROM aligned WHERE region = 'R'
UNION ALL SELECT 'posttx:binding:scored', src_pos, dst_pos FROM aligned WHERE score >= 5""")
def edges_union_typed(spark, d):
    edges = aligned(spark, d)
    spec = lambda layer, relation, name: {"layer": layer, "relation": relation, "name": name}
    return E.union_typed([
        (spec("trans", "tf_target", "regulators"), E.filter_confidence(edges)),
        (spec("posttx", "binding", "sites"), E.filter_region(edges, "R")),
        (spec("posttx", "binding", "scored"), E.filter_score(edges, 5)),
    ])


@query("edges_filter_confidence", f"{BASE} SELECT src_pos, dst_pos, confidence, region, score FROM aligned WHERE confidence <= 'C'")
def edges_filter_confidence(spark, d):
    return E.filter_confidence(aligned(spark, d)).select(*COLUMNS)


@query("edges_filter_score", f"{BASE} SELECT src_pos, dst_pos, confidence, region, score FROM aligned WHERE score >= (SELECT avg(score) FROM edges)")
def edges_filter_score(spark, d):
    threshold = T.edges(spark, d).agg(F.avg("score")).first()[0]
    return E.filter_score(aligned(spark, d), threshold).select(*COLUMNS)


@query("edges_filter_region", f"{BASE} SELECT src_pos, dst_pos, confidence, region, score FROM aligned WHERE region = 'A'")
def edges_filter_region(spark, d):
    return E.filter_region(aligned(spark, d), "A").select(*COLUMNS)


@query("edges_symmetrize", f"{BASE} SELECT src_pos, dst_pos FROM aligned UNION SELECT dst_pos, src_pos FROM aligned")
def edges_symmetrize(spark, d):
    return E.symmetrize(aligned(spark, d))


@query("edges_aggregate_score", f"{BASE} SELECT dst_pos, CAST(sum(score) AS BIGINT) AS score_sum, max(score) AS score_max, count(*) AS n_edges FROM aligned GROUP BY 1")
def edges_aggregate_score(spark, d):
    return E.aggregate_score(aligned(spark, d))


@query("node_features_concat", f"""
WITH {GENES}, chunk AS (SELECT 'Brand#' || label AS gene, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  pooled AS (SELECT gene, dim, avg(v) AS v FROM chunk GROUP BY 1, 2),
  extra AS (SELECT 'Brand#' || (s_suppkey % 20) AS gene, count(*) AS n, sum(s_acctbal) AS bal FROM supplier GROUP BY 1)
SELECT gene_pos, CAST(dim AS BIGINT) AS dim, round(coalesce(p.v, 0), 6) + 0.0 AS value
FROM genes CROSS JOIN (SELECT unnest(range(64)) AS dim) r LEFT JOIN pooled p USING (gene, dim)
UNION ALL SELECT gene_pos, 64, coalesce(n, 0) FROM genes LEFT JOIN extra USING (gene)
UNION ALL SELECT gene_pos, 65, round(coalesce(bal, 0), 6) + 0.0 FROM genes LEFT JOIN extra USING (gene)""")
def node_features_concat(spark, d):
    index = axis.gene_index(T.genes(spark, d), "gene")
    chunks = T.table(spark, d, "embeddings").select(F.concat(F.lit("Brand#"), F.col("label").cast("string")).alias("gene"), "embedding")
    pooled = E.pool_chunks(chunks, "gene", "embedding").groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v"))
    first = axis.to_positions(pooled, index, "gene").select("gene_pos", F.col("v.value").alias("features"))
    supplier = T.table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 20).cast("string")).alias("gene"), "s_acctbal")
    sums = supplier.groupBy("gene").agg(F.array(F.count("*").cast("double"), F.sum("s_acctbal")).alias("features"))
    second = axis.to_positions(sums, index, "gene").select("gene_pos", "features")
    rows = E.concat_features(index, [(first, 64), (second, 2)])
    return rows.select("gene_pos", F.posexplode("features").alias("dim", "value")).select("gene_pos", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


RAW = {"cell_id": "barcode", "pert_col": "perturbation", "control_label": "NTC", "context_col": "cell_line", "context_prefix": "line:"}


def raw_source(cells: DataFrame) -> DataFrame:
    label = F.when(F.col("target_gene") == "non-targeting", "NTC").otherwise(F.col("target_gene"))
    return cells.select(F.col("cell_id").alias("barcode"), label.alias("perturbation"), F.col("context").alias("cell_line"))


@query("harmonize", f"""
SELECT o_orderkey AS cell_id, CASE WHEN o_custkey % 26 = 0 THEN 'non-targeting' ELSE 'Brand#' || (o_custkey % 26) END AS target_gene,
  'line:' || o_orderpriority AS context FROM orders""")
def harmonize(spark, d):
    """A raw table with its own names, control label and contexts, brought to the canonical columns."""
    return harmonize_cells(raw_source(T.cells(spark, d)), RAW)


@query("harmonize_tables", f"""
WITH {CELLS}, {EXPR}, {GENES}, ids AS (SELECT p_brand AS gene, min('ENSG' || lpad(CAST(p_size AS VARCHAR), 11, '0')) AS ensembl_id
  FROM part WHERE CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) <= 22 GROUP BY 1)
SELECT 'cell' AS part, CAST(cell_id AS VARCHAR) AS id, target_gene AS name, 'line:' || context AS other, CAST(NULL AS DOUBLE) AS value FROM cells
UNION ALL SELECT 'gene', CAST(gene_pos AS VARCHAR), gene, i.ensembl_id, NULL FROM genes LEFT JOIN ids i USING (gene)
UNION ALL SELECT 'entry', CAST(cell_id AS VARCHAR), gene, NULL, value FROM expr""")
def harmonize_tables(spark, d):
    """All three tables from a raw source without gene ids: these come from a map with several ids for a gene and none for some."""
    raw = raw_source(T.cells(spark, d))
    expr = T.expr(spark, d).select(F.col("cell_id").alias("barcode"), "gene", "value")
    number = F.regexp_extract("p_brand", r"([0-9]+)", 1).cast("int")
    ids = T.table(spark, d, "part").filter(number <= 22).select(
        F.col("p_brand").alias("gene"), F.concat(F.lit("ENSG"), F.lpad(F.col("p_size").cast("string"), 11, "0")).alias("ensembl_id")
    )
    return T.long_rows(harmonize_matrix(raw, T.genes(spark, d).drop("ensembl_id"), expr, RAW, ids))


@query("qc_report", f"""
WITH {CELLS}, {EXPR}, {GENES}
SELECT count(*) AS n_cells, count(DISTINCT target_gene) - 1 AS n_perturbations, count(*) FILTER (target_gene = 'non-targeting') AS n_control_cells, 'raw_counts' AS state,
  count(*) FILTER (cell_id NOT IN (SELECT cell_id FROM expr)) AS n_empty_cells,
  round((SELECT count(*) FILTER (gene_pos < 20) / count(*) FROM genes), 6) AS id_coverage FROM cells""")
def qc_report(spark, d):
    known = axis.gene_index(T.genes(spark, d).filter("gene_pos < 20"), "ensembl_id")
    return PR.qc_report(T.count_matrix(spark, d), known, "ensembl_id").withColumn("id_coverage", r6("id_coverage"))
