"""Queries: joins on the gene axis, on labels, on manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pertmatrix.matrix import CONTROL
from pertmatrix.operators import axis, cells as C, contract as K, edges as E, effects as FX, manifest as M, predictors as R, profile as PR, pseudobulk as P
from pertmatrix.plans.q_sources import CONTEXTS
from pertmatrix.plans.registry import CELLS, GENES, MATRIX_LOG, query, r6
from pertmatrix.session import materialized
from pertmatrix.sources import testdata as T


def targets(spark, d) -> DataFrame:
    """Requested targets: thirty labels, five of which no source perturbs."""
    name = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string"))
    return T.table(spark, d, "lineitem").select(name.alias("target_gene")).distinct()


TARGETS = "targets AS (SELECT DISTINCT 'Brand#' || (l_suppkey % 30) AS target_gene FROM lineitem)"


@query("join_remap_axis", f"""
WITH {GENES}, src AS (SELECT 'Brand#' || (s_suppkey % 20) AS gene, s_suppkey AS pos, s_acctbal AS value FROM supplier),
  last AS (SELECT gene, arg_max(value, pos) AS value FROM src GROUP BY 1)
SELECT gene_pos, gene, coalesce(value, -1.0) AS value FROM genes LEFT JOIN last USING (gene)""")
def join_remap_axis(spark, d):
    source = T.table(spark, d, "supplier").select(
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 20).cast("string")).alias("gene"),
        F.col("s_suppkey").alias("gene_pos"), F.col("s_acctbal").alias("value"),
    )
    return FX.remap_to_axis(source.drop("gene"), source, T.genes(spark, d), fill=-1.0)


def part_axis(spark, d) -> DataFrame:
    """A wide axis with repeated ids: every part is a position, its size and brand make the id."""
    k = F.col("p_size") * 100 + F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return T.table(spark, d, "part").select(
        F.col("p_partkey").alias("gene_pos"), F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0")).alias("ensembl_id"),
        F.col("p_brand").alias("gene_id"), F.col("p_name").alias("gene"),
    )


PART_AXIS = """axis AS (SELECT p_partkey AS gene_pos, p_brand AS gene_id, p_name AS gene,
  'ENSG' || lpad(CAST(p_size * 100 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS VARCHAR), 11, '0') AS ensembl_id FROM part)"""


@query("join_gene_index", f"WITH {PART_AXIS} SELECT ensembl_id AS gene_id, min(gene_pos) AS gene_pos, count(*) AS n_seen FROM axis GROUP BY 1")
def join_gene_index(spark, d):
    genes = part_axis(spark, d)
    return axis.gene_index(genes, axis.resolve_id_column(genes, "ensembl_gene_id"))


CANDIDATES = """cand AS (
  SELECT 'ensembl_id' AS candidate, 0 AS ord, avg(CASE WHEN regexp_matches(ensembl_id, '^ENSG[0-9]{11}') THEN 1.0 ELSE 0 END) AS valid_fraction FROM axis
  UNION ALL SELECT 'gene_id', 1, avg(CASE WHEN regexp_matches(gene_id, '^ENSG[0-9]{11}') THEN 1.0 ELSE 0 END) FROM axis
  UNION ALL SELECT 'gene', 2, avg(CASE WHEN regexp_matches(gene, '^ENSG[0-9]{11}') THEN 1.0 ELSE 0 END) FROM axis)"""


@query("resolve_id_column", f"WITH {PART_AXIS}, {CANDIDATES} SELECT candidate, CAST(ord AS BIGINT) AS ord, valid_fraction FROM cand")
def resolve_id_column(spark, d):
    return axis.id_candidates(part_axis(spark, d), "ensembl_gene_id")


EDGE_IDS = "'Brand#' || (l_suppkey % 30)"


@query("join_coverage", f"""
WITH {GENES}, ids AS (SELECT l_returnflag, {EDGE_IDS} AS id FROM lineitem)
SELECT l_returnflag, count(*) AS n_ids, count(gene) AS n_known, round(count(gene) / count(*), 6) AS coverage,
  CASE WHEN count(gene) = 0 THEN 'error' WHEN count(gene) / count(*) < 0.5 THEN 'warning' ELSE 'ok' END AS verdict
FROM ids LEFT JOIN genes ON id = gene GROUP BY 1""")
def join_coverage(spark, d):
    ids = T.table(spark, d, "lineitem").select("l_returnflag", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 30).cast("string")).alias("id"))
    cov = axis.coverage(ids, axis.gene_index(T.genes(spark, d), "gene"), "id", by=["l_returnflag"])
    return axis.coverage_verdict(cov).withColumn("coverage", r6("coverage"))


EDGES = """edges AS (
  SELECT 'Brand#' || (l_suppkey % 30) AS src, p_brand AS dst, substr('ABCDE', CAST(1 + l_linenumber % 5 AS INTEGER), 1) AS confidence,
         l_returnflag AS region, count(*) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""
ALIGNED = """aligned AS (SELECT e.*, s.gene_pos AS src_pos, t.gene_pos AS dst_pos FROM edges e JOIN genes s ON s.gene = src JOIN genes t ON t.gene = dst)"""


@query("join_edges_both_endpoints", f"""
WITH {GENES}, {EDGES}, {ALIGNED} SELECT src_pos, dst_pos, confidence, region, score FROM aligned WHERE src_pos <> dst_pos""")
def join_edges_both_endpoints(spark, d):
    index = axis.gene_index(T.genes(spark, d), "gene")
    return E.align_edges(T.edges(spark, d), index, drop_self_loops=True).select("src_pos", "dst_pos", "confidence", "region", "score")


@query("join_positions", f"""
WITH {GENES} SELECT s_suppkey, gene_pos FROM (SELECT s_suppkey, 'Brand#' || (s_suppkey % 30) AS id FROM supplier) s JOIN genes ON id = gene""")
def join_positions(spark, d):
    ids = T.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30).cast("string")).alias("id"))
    return axis.to_positions(ids, axis.gene_index(T.genes(spark, d), "gene"), "id").select("s_suppkey", "gene_pos")


GROUP_MEANS = """
  gsize AS (SELECT context, target_gene, count(*) AS n FROM cells GROUP BY 1, 2),
  gmean AS (SELECT context, target_gene, gene, coalesce(s, 0) / n AS value FROM gsize CROSS JOIN genes
            LEFT JOIN (SELECT context, target_gene, gene, sum(value) AS s FROM logged GROUP BY 1, 2, 3) q USING (context, target_gene, gene)),
  gctrl AS (SELECT gene, avg(value) AS control FROM gmean WHERE target_gene = 'non-targeting' GROUP BY 1)"""


@query("join_control_profile", f"""
WITH {MATRIX_LOG}, {GROUP_MEANS} SELECT context, target_gene, gene, round(value - control, 6) + 0.0 AS delta FROM gmean JOIN gctrl USING (gene)""")
def join_control_profile(spark, d):
    m = T.count_matrix(spark, d)
    profiles = materialized(
        P.group_profiles(C.log_normalized(C.labelled(m)), m.cells, m.genes, ["context", "target_gene"], "mean", min_cells=0), "profiles"
    )
    return profiles.join(P.control_profile(profiles), "gene").select(
        "context", "target_gene", "gene", r6(F.col("value") - F.col("control")).alias("delta")
    )


LABEL_STATS = """
  lsize AS (SELECT target_gene, count(*) AS n FROM cells GROUP BY 1),
  lmean AS (SELECT target_gene, gene_pos, gene, n, coalesce(s, 0) / n AS m, greatest(coalesce(ss, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n), 0) AS v
            FROM lsize CROSS JOIN genes LEFT JOIN (SELECT target_gene, gene, sum(value) AS s, sum(value * value) AS ss FROM logged GROUP BY 1, 2) q USING (target_gene, gene)),
  tdelta AS (SELECT p.target_gene, p.gene_pos, p.gene, p.m - c.m AS delta, (p.m - c.m) / greatest(sqrt(c.v / c.n + p.v / p.n), 1e-9) AS z, c.m AS m_c, c.v AS v_c
             FROM lmean p JOIN lmean c ON c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting' AND p.n >= 10)"""


@query("join_self_gene", f"WITH {MATRIX_LOG}, {LABEL_STATS} SELECT target_gene, round(delta, 6) + 0.0 AS delta FROM tdelta WHERE gene = target_gene")
def join_self_gene(spark, d):
    m = T.count_matrix(spark, d)
    deltas = R.training_deltas(materialized(P.label_moments(C.log_normalized(C.labelled(m)), m.cells, m.genes), "moments"))
    return deltas.filter(F.col("gene") == F.col("target_gene")).select("target_gene", r6("delta").alias("delta"))


@query("join_sources_on_target", f"""
WITH {CELLS}, {TARGETS}, src AS (SELECT DISTINCT context, target_gene FROM cells WHERE target_gene <> 'non-targeting')
SELECT target_gene, count(context) AS n_sources, count(context) > 0 AS covered FROM targets LEFT JOIN src USING (target_gene) GROUP BY 1""")
def join_sources_on_target(spark, d):
    sources = T.cells(spark, d).filter(F.col("target_gene") != CONTROL).select("context", "target_gene").distinct()
    joined = targets(spark, d).join(sources, "target_gene", "left").groupBy("target_gene").agg(F.count("context").alias("n_sources"))
    return joined.withColumn("covered", F.col("n_sources") > 0)


RECORDED = """recorded AS (SELECT source || ':' || lang AS record_id, CAST(doc_id AS VARCHAR) AS name, n_chars AS size_bytes,
  CASE WHEN doc_id % 50 <> 0 THEN 'md5:' || md5(text) END AS checksum, doc_id FROM documents)"""


def drifted(files: DataFrame) -> DataFrame:
    """A later version of the manifest: some sizes, checksums and names differ."""
    k = F.col("name").cast("bigint")
    return (
        files.withColumn("size_bytes", F.when(k % 97 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
        .withColumn("checksum", F.when(k % 31 == 0, F.lit("md5:0")).otherwise(F.col("checksum")))
        .withColumn("name", F.when(k % 89 == 0, F.concat(F.lit("new-"), F.col("name"))).otherwise(F.col("name")))
    )


@query("join_file_manifest_diff", f"""
WITH {RECORDED}, cur AS (
  SELECT record_id, CASE WHEN doc_id % 89 = 0 THEN 'new-' || name ELSE name END AS name,
    size_bytes + CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN doc_id % 31 = 0 THEN 'md5:0' ELSE checksum END AS checksum FROM recorded)
SELECT record_id, name, 'removed' AS change FROM recorded ANTI JOIN cur USING (record_id, name)
UNION ALL SELECT record_id, name, 'added' FROM cur ANTI JOIN recorded USING (record_id, name)
UNION ALL SELECT record_id, name, 'size' FROM recorded r JOIN cur c USING (record_id, name) WHERE r.size_bytes <> c.size_bytes
UNION ALL SELECT record_id, name, 'checksum' FROM recorded r JOIN cur c USING (record_id, name) WHERE r.checksum IS DISTINCT FROM c.checksum""")
def join_file_manifest_diff(spark, d):
    files = T.host_files(spark, d)
    return M.manifest_diff(files, drifted(files))


@query("semi_perturbed_also_measured", f"""
WITH {CELLS}, {GENES}, p AS (SELECT DISTINCT target_gene FROM cells WHERE target_gene <> 'non-targeting')
SELECT count(gene) AS n_measured, count(*) AS n_perturbations FROM p LEFT JOIN genes ON gene = target_gene""")
def semi_perturbed_also_measured(spark, d):
    return PR.perturbed_and_measured(T.cells(spark, d), T.genes(spark, d))


@query("anti_expected_grid", f"""
WITH {CELLS}, {TARGETS}, grid AS (SELECT context, target_gene FROM (SELECT DISTINCT context FROM cells WHERE context <> '5-LOW') c CROSS JOIN targets),
  blocks AS (SELECT DISTINCT context, target_gene FROM cells)
SELECT 'missing' AS problem, * FROM (SELECT * FROM grid EXCEPT SELECT * FROM blocks)
UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM blocks EXCEPT SELECT * FROM grid)""")
def anti_expected_grid(spark, d):
    contract = K.Contract(T.genes(spark, d), targets(spark, d), CONTEXTS[:4])
    return K.block_differences(contract, T.cells(spark, d)).filter("problem != 'wrong count'").select("problem", "context", "target_gene")
