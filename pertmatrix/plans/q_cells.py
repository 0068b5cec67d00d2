"""Queries: filters, splits, samples, and per-cell projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from pertmatrix.functions import columns as X
from pertmatrix.matrix import CONTROL, CountMatrix
from pertmatrix.operators import axis, cells as C, effects as FX, emit, manifest as M, predictors as R, pseudobulk as P, sampling as S
from pertmatrix.plans.q_sources import CAP_SQL, CONTEXTS, HOLDOUT_SQL, LICENSE_SQL, PROFILE_SQL, host_responses
from pertmatrix.plans.registry import CELLS, EXPR, LIB, MATRIX, MATRIX_LOG, query, r6
from pertmatrix.session import materialized
from pertmatrix.sources import scans, testdata as T

HELD_OUT = CONTEXTS[0]


# -- filters ---------------------------------------------------------------------------------


@query("filter_control_exact", f"WITH {CELLS} SELECT cell_id FROM cells WHERE target_gene = 'non-targeting'")
def filter_control_exact(spark, d):
    return C.control_cells(T.cells(spark, d)).select("cell_id")


@query("filter_control_near_miss", f"""
WITH {CELLS} SELECT DISTINCT target_gene FROM cells WHERE lower(target_gene) LIKE '%brand#1%' AND target_gene <> 'brand#1'
ORDER BY 1 LIMIT 5""")
def filter_control_near_miss(spark, d):
    return C.near_control_labels(T.cells(spark, d), "brand#1")


@query("filter_labels", f"""
WITH {CELLS} SELECT cell_id, target_gene FROM cells
WHERE target_gene IN (SELECT 'Brand#' || c_nationkey FROM customer) AND target_gene NOT IN (SELECT 'Brand#' || n_regionkey FROM nation)""")
def filter_labels(spark, d):
    keep = T.table(spark, d, "customer").select(F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string"))).distinct()
    skip = T.table(spark, d, "nation").select(F.concat(F.lit("Brand#"), F.col("n_regionkey").cast("string"))).distinct()
    return C.filter_labels(T.cells(spark, d), keep, skip).select("cell_id", "target_gene")


@query("filter_empty_cells", f"WITH {EXPR}, {LIB} SELECT o_orderkey AS cell_id, libsize FROM orders JOIN lib ON o_orderkey = cell_id WHERE libsize > 0")
def filter_empty_cells(spark, d):
    return C.filter_empty(T.count_matrix(spark, d)).select("cell_id", "libsize")


@query("filter_min_libsize", f"WITH {EXPR}, {LIB} SELECT o_orderkey AS cell_id, libsize FROM orders JOIN lib ON o_orderkey = cell_id WHERE libsize > 100")
def filter_min_libsize(spark, d):
    return C.filter_min_libsize(C.cell_libsize(T.count_matrix(spark, d)), 100).select("cell_id", "libsize")


@query("filter_libsize_quantiles", f"""
WITH {CELLS}, {EXPR}, {LIB}, q AS (
  SELECT context, quantile_cont(libsize, 0.05) AS lo, quantile_cont(libsize, 0.95) AS hi FROM cells JOIN lib USING (cell_id) GROUP BY 1)
SELECT cell_id, context, libsize FROM cells JOIN lib USING (cell_id) JOIN q USING (context) WHERE libsize BETWEEN lo AND hi""")
def filter_libsize_quantiles(spark, d):
    cells = C.filter_empty(T.count_matrix(spark, d))
    return C.filter_libsize_quantiles(cells, 0.05, 0.95).select("cell_id", "context", "libsize")


@query("filter_min_cells", f"""
WITH {CELLS} SELECT context, target_gene, count(*) AS n_cells FROM cells GROUP BY 1, 2
HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM cells GROUP BY context, target_gene) s)""")
def filter_min_cells(spark, d):
    cells = T.cells(spark, d)
    by = ["context", "target_gene"]
    mean = P.group_sizes(cells, by).agg(F.avg("n_cells")).first()[0]
    return P.require_rows(P.group_sizes(cells, by, min_cells=mean), "every group is below min_cells")


@query("split_train_holdout", f"""
WITH {CELLS}, {HOLDOUT_SQL}
SELECT target_gene, n_cells, CASE WHEN target_gene IN (SELECT target_gene FROM hold) THEN 'holdout' ELSE 'train' END AS side FROM per_label""")
def split_train_holdout(spark, d):
    return S.carve_holdout(T.cells(spark, d), 8, seed=7)


@query("split_leave_one_context_out", f"""
WITH {CELLS} SELECT CASE WHEN context = '1-URGENT' THEN 'profile' ELSE 'source' END AS role, context, target_gene, count(*) AS n_cells
FROM cells WHERE context <> '1-URGENT' OR target_gene = 'non-targeting' GROUP BY 1, 2, 3""")
def split_leave_one_context_out(spark, d):
    sources, own = S.leave_one_context_out(T.cells(spark, d), HELD_OUT)
    both = sources.withColumn("role", F.lit("source")).unionByName(own.withColumn("role", F.lit("profile")))
    return both.groupBy("role", "context", "target_gene").agg(F.count("*").alias("n_cells"))


@query("sample_cap_per_label", f"WITH {CELLS}, {CAP_SQL} SELECT cell_id, target_gene FROM capped")
def sample_cap_per_label(spark, d):
    return S.cap_per_label(T.cells(spark, d), 50, 200, seed=1).select("cell_id", "target_gene")


@query("sample_control_cap", f"""
WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY target_gene ORDER BY md5('2:' || target_gene || ':' || cell_id), cell_id) AS k FROM cells)
SELECT cell_id, target_gene FROM r WHERE target_gene <> 'non-targeting' OR k <= 300""")
def sample_control_cap(spark, d):
    return S.cap_control(T.cells(spark, d), 300, seed=2).select("cell_id", "target_gene")


@query("sample_max_cells", f"""
WITH {CELLS} SELECT cell_id FROM cells ORDER BY md5('5:' || cell_id), cell_id LIMIT 5000""")
def sample_max_cells(spark, d):
    return S.cap_cells(T.cells(spark, d), 5000, seed=5).select("cell_id")


DRAW_SQL = """
  pool AS (SELECT cell_id, row_number() OVER (ORDER BY md5('pool0:' || cell_id), cell_id) - 1 AS pool_idx FROM cells WHERE target_gene = 'non-targeting'),
  wanted AS (SELECT target_gene, count(*) AS n FROM cells WHERE target_gene <> 'non-targeting' GROUP BY 1),
  draws AS (SELECT target_gene, i AS cell_no,
              CAST('0x' || substr(md5('draw0:' || target_gene || ':' || i), 1, 15) AS BIGINT) % (SELECT count(*) FROM pool) AS pool_idx
            FROM (SELECT target_gene, unnest(range(n)) AS i FROM wanted) w)"""


@query("sample_with_replacement", f"WITH {CELLS}, {DRAW_SQL} SELECT target_gene, cell_no, cell_id FROM draws JOIN pool USING (pool_idx)")
def sample_with_replacement(spark, d):
    cells = T.cells(spark, d)
    own = cells.filter(F.col("target_gene") == CONTROL)
    pool = S.index_pool(own.select("cell_id"), [])
    wanted = S.count_labels(cells).filter(F.col("target_gene") != CONTROL).withColumn(
        "pool_n", own.agg(F.count("*").alias("n")).scalar()
    )
    draws = S.draw_with_replacement(wanted, "n_cells", F.col("pool_n"), ["target_gene"])
    return draws.join(pool, "pool_idx").select("target_gene", F.col("draw_no").alias("cell_no"), "cell_id")


@query("relabel_control", f"""
WITH {CELLS} SELECT CASE WHEN target_gene = 'non-targeting' THEN 'control' ELSE target_gene END AS target_gene, cell_id FROM cells""")
def relabel_control(spark, d):
    return C.relabel_control(T.cells(spark, d), CONTROL, "control").select("target_gene", "cell_id")


# -- per-cell projections --------------------------------------------------------------------


@query("cell_libsize", f"WITH {EXPR}, {LIB} SELECT o_orderkey AS cell_id, coalesce(libsize, 0) AS libsize FROM orders LEFT JOIN lib ON o_orderkey = cell_id")
def cell_libsize(spark, d):
    return C.cell_libsize(T.count_matrix(spark, d)).select("cell_id", "libsize")


@query("cell_cpm", f"WITH {EXPR}, {LIB} SELECT cell_id, gene, round(value / libsize * 1e6 / 1e6, 6) + 0.0 AS cpm FROM expr JOIN lib USING (cell_id)")
def cell_cpm(spark, d):
    entries = C.scaled(C.with_libsize(T.expr(spark, d)), 1e6, out="cpm")
    return entries.select("cell_id", "gene", r6("cpm", 1e6).alias("cpm"))


@query("cell_cp10k", f"WITH {EXPR}, {LIB} SELECT cell_id, gene, round(value / libsize * 1e4 / 1e4, 6) + 0.0 AS value FROM expr JOIN lib USING (cell_id)")
def cell_cp10k(spark, d):
    m = T.count_matrix(spark, d)
    nonempty = CountMatrix(m.cells.join(m.expr.select("cell_id"), "cell_id", "left_semi"), m.genes, m.expr)
    return C.cp10k(nonempty).select("cell_id", "gene", r6("value", 1e4).alias("value"))


@query("normalize_log1p", f"WITH {MATRIX_LOG} SELECT cell_id, gene, round(value, 6) + 0.0 AS value FROM logged")
def normalize_log1p(spark, d):
    m = C.rows_written(T.count_matrix(spark, d))
    entries = C.labelled(m)
    if C.rows_state(m.rows).first().state == C.RAW:
        entries = C.log_normalized(entries)
    return entries.select("cell_id", "gene", r6("value").alias("value"))


CPM_GRID = """
  sizes AS (SELECT target_gene, count(DISTINCT cell_id) AS n FROM entries GROUP BY 1),
  cpm AS (SELECT target_gene, gene, sum(value / libsize * 1e6) AS s, sum((value / libsize * 1e6) * (value / libsize * 1e6)) AS ss FROM entries GROUP BY 1, 2),
  mv AS (SELECT target_gene, gene, n, coalesce(s, 0) / n AS m, greatest(coalesce(ss, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n), 0) AS v
         FROM sizes CROSS JOIN genes LEFT JOIN cpm USING (target_gene, gene)),
  eff AS (SELECT p.target_gene, p.gene, log2((p.m + 1) / (c.m + 1)) AS fc,
            (p.v / p.n / power(p.m + 1, 2) + c.v / c.n / power(c.m + 1, 2)) / power(ln(2), 2) AS var
          FROM mv p JOIN mv c ON c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting')"""


@query("log2fc", f"WITH {MATRIX}, {CPM_GRID} SELECT target_gene, gene, round(fc, 6) + 0.0 AS log2fc FROM eff")
def log2fc(spark, d):
    m = T.count_matrix(spark, d)
    grid = P.mean_var_cpm(P.label_sums(m, save=True), m.genes)
    ctrl = grid.filter(F.col("target_gene") == CONTROL).select("gene", F.col("mean_cpm").alias("m_c"))
    pert = grid.filter(F.col("target_gene") != CONTROL).join(ctrl, "gene")
    return pert.select("target_gene", "gene", r6(X.log2_fold_change(F.col("mean_cpm"), F.col("m_c"))).alias("log2fc"))


RUNG0B_SQL = """
  n AS (SELECT count(*) FILTER (target_gene = 'non-targeting') AS c, count(*) FILTER (target_gene <> 'non-targeting') AS p FROM cells),
  rung0b AS (SELECT gene_pos, gene, coalesce(sum(value) FILTER (target_gene <> 'non-targeting'), 0) / (SELECT p FROM n)
               - coalesce(sum(value) FILTER (target_gene = 'non-targeting'), 0) / (SELECT c FROM n) AS delta
             FROM genes LEFT JOIN logged USING (gene) GROUP BY 1, 2)"""


@query("shift_clip_floor", f"""
WITH {MATRIX_LOG}, {RUNG0B_SQL}, f AS (SELECT min(value) AS lowest FROM logged WHERE target_gene = 'non-targeting' AND value > 0)
SELECT cell_id, gene, round(CASE WHEN greatest(value + 20 * delta, 0) < lowest THEN 0 ELSE greatest(value + 20 * delta, 0) END, 6) + 0.0 AS value
FROM logged JOIN rung0b USING (gene), f WHERE target_gene = 'non-targeting'""")
def shift_clip_floor(spark, d):
    m = T.count_matrix(spark, d)
    logged = C.log_normalized(C.labelled(m))
    delta = R.mean_perturbation_delta(P.label_moments(logged, m.cells, m.genes)).select("gene", (F.col("delta") * 20).alias("delta"))
    delta = materialized(delta, "delta")
    shifted = logged.filter(F.col("target_gene") == CONTROL).join(delta, "gene").withColumn("floor", R.assay_floor(logged).scalar())
    return shifted.select("cell_id", "gene", r6(X.shift_clip_floor(F.col("value"), F.col("delta"), F.col("floor"))).alias("value"))


@query("shift_fraction", f"""
WITH {MATRIX}, {PROFILE_SQL}, {CPM_GRID},
  moved AS (SELECT context, target_gene, gene, fraction * power(2, fc) AS x FROM prof JOIN eff USING (gene))
SELECT context, target_gene, gene, round(x / sum(x) OVER (PARTITION BY context, target_gene), 6) + 0.0 AS fraction FROM moved""")
def shift_fraction(spark, d):
    m = C.rows_written(T.count_matrix(spark, d))
    profile, _ = emit.context_profile(C.labelled(m), m.genes)
    shifts = FX.log2fc_with_var(P.label_sums(m, save=True), m.genes).withColumnRenamed("log2fc", "shift")
    return emit.shift_fraction(profile, shifts).select("context", "target_gene", "gene", r6("fraction").alias("fraction"))


@query("scale_cap_row_total", f"""
WITH {EXPR}, {LIB}, cut AS (
  SELECT cell_id, gene, CASE WHEN libsize > 100 THEN floor(value * 100.0 / libsize) ELSE value END AS value FROM expr JOIN lib USING (cell_id))
SELECT cell_id, gene, CAST(value AS DOUBLE) AS value FROM cut WHERE value > 0""")
def scale_cap_row_total(spark, d):
    return C.cap_row_total(T.expr(spark, d), 100, ["cell_id"])


SHRUNK = "CASE WHEN fc = 0 THEN 0 ELSE fc * greatest(0, least(1, 1 - var / greatest(fc * fc, 1e-12))) END"


@query("shrink_positive_part", f"WITH {MATRIX}, {CPM_GRID} SELECT target_gene, gene, round({SHRUNK}, 6) + 0.0 AS log2fc FROM eff")
def shrink_positive_part(spark, d):
    m = T.count_matrix(spark, d)
    return FX.shrink(FX.log2fc_with_var(P.label_sums(m, save=True), m.genes)).select("target_gene", "gene", r6("log2fc").alias("log2fc"))


@query("id_shape_match", """
SELECT avg(CASE WHEN regexp_matches(ens, '^ENSG[0-9]{11}') THEN 1.0 ELSE 0 END) AS ensembl_fraction,
       avg(CASE WHEN sym NOT IN ('nan', 'None', '') THEN 1.0 ELSE 0 END) AS symbol_fraction
FROM (SELECT CASE WHEN p_size % 7 = 0 THEN p_brand ELSE 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') END AS ens,
             CASE WHEN p_size % 5 = 0 THEN 'nan' WHEN p_size % 5 = 1 THEN '' ELSE p_brand END AS sym FROM part) x""")
def id_shape_match(spark, d):
    size = F.col("p_size")
    part = T.table(spark, d, "part").select(
        F.when(size % 7 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("ENSG"), F.lpad(F.col("p_partkey").cast("string"), 11, "0"))).alias("ens"),
        F.when(size % 5 == 0, "nan").when(size % 5 == 1, "").otherwise(F.col("p_brand")).alias("sym"),
    )
    return part.agg(
        F.avg(axis.id_shape("ens", "ensembl_gene_id").cast("double")).alias("ensembl_fraction"),
        F.avg(axis.id_shape("sym", "hgnc_symbol").cast("double")).alias("symbol_fraction"),
    )


@query("license_flags", f"""
SELECT DISTINCT record_id, license, license IN ('CC-BY-NC-4.0', 'CC-BY-NC-SA-4.0') AS noncommercial,
  license IN ('CC-BY-SA-4.0', 'CC-BY-NC-SA-4.0') AS redistribution_encumbered
FROM (SELECT source || ':' || lang || ':' || (doc_id // 1000) AS record_id, {LICENSE_SQL} AS license FROM documents) r""")
def license_flags(spark, d):
    records, _ = scans.scan_host_records(host_responses(spark, d), "hostrecord")
    return M.license_flags(records).select("record_id", "license", "noncommercial", "redistribution_encumbered")


@query("project_provenance", f"""
SELECT DISTINCT 'hostrecord' AS source, source || ':' || lang || ':' || (doc_id // 1000) AS accession, {LICENSE_SQL} AS license, '2026-08-16' AS retrieved
FROM documents""")
def project_provenance(spark, d):
    records, _ = scans.scan_host_records(host_responses(spark, d), "hostrecord")
    return M.to_provenance(records.withColumn("retrieved", F.lit("2026-08-16")))
