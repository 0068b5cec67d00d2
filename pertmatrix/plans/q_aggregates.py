"""Queries: pseudobulks, profiles, effects, models, dataset statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pertmatrix.matrix import CONTROL, CountMatrix, unpack_dense
from pertmatrix.operators import cells as C, edges as E, effects as FX, emit, metrics as Q, predictors as R, profile as PR, pseudobulk as P, sampling as S
from pertmatrix.operators.axis import require_same_axis
from pertmatrix.plans.q_cells import HELD_OUT, RUNG0B_SQL, SHRUNK
from pertmatrix.plans.q_joins import LABEL_STATS, TARGETS, targets
from pertmatrix.plans.q_sources import PB_ROWS, PB_SQL, PROFILE_SQL, pb_rows
from pertmatrix.plans.registry import CELLS, EXPR, GENES, LIB, MATRIX, MATRIX_LOG, query, r6
from pertmatrix.session import materialized
from pertmatrix.sources import testdata as T


def logged_matrix(spark, d) -> tuple[CountMatrix, DataFrame]:
    m = T.count_matrix(spark, d)
    return m, C.log_normalized(C.labelled(m))


# -- pseudobulk sums -------------------------------------------------------------------------


@query("pb_stream_sums", f"WITH {MATRIX}, {PB_SQL} {PB_ROWS}")
def pb_stream_sums(spark, d):
    return pb_rows(P.label_sums(T.count_matrix(spark, d), save=True))


@query("pb_mean_var_cpm", f"""
WITH {MATRIX}, {PB_SQL}, mv AS (
  SELECT target_gene, gene, n_cells, coalesce(cpm_sum, 0) / greatest(n_cells, 1) AS m, coalesce(cpm_sq_sum, 0) / greatest(n_cells, 1) AS sq
  FROM pl CROSS JOIN genes LEFT JOIN pb USING (target_gene, gene))
SELECT target_gene, gene, n_cells, round(m / 1e6, 6) + 0.0 AS mean_cpm, round(greatest(sq - m * m, 0) / 1e12, 6) + 0.0 AS var_cpm FROM mv""")
def pb_mean_var_cpm(spark, d):
    m = T.count_matrix(spark, d)
    return P.mean_var_cpm(P.label_sums(m, save=True), m.genes).select(
        "target_gene", "gene", "n_cells", r6("mean_cpm", 1e6).alias("mean_cpm"), r6("var_cpm", 1e12).alias("var_cpm")
    )


@query("pb_merge", f"WITH {MATRIX}, {PB_SQL} {PB_ROWS}")
def pb_merge(spark, d):
    m = C.rows_written(T.count_matrix(spark, d))
    require_same_axis(m.genes, T.genes(spark, d))
    finished = F.col("batch") == "F"
    passes = [P.label_sums(m.where(part), save=True) for part in (finished, ~finished)]
    return pb_rows(P.merge(*passes))


@query("pb_control_once", f"WITH {MATRIX}, {PB_SQL} {PB_ROWS}")
def pb_control_once(spark, d):
    m = T.count_matrix(spark, d)
    control = F.col("target_gene") == CONTROL
    finished = F.col("batch") == "F"
    files = m.cells.filter(control | finished).withColumn("source_ord", F.lit(0)).unionByName(
        m.cells.filter(control | ~finished).withColumn("source_ord", F.lit(1))
    )
    return pb_rows(P.label_sums(CountMatrix(P.control_once(files), m.genes, m.expr), save=True))


def profile_sql(value: str, min_cells: int = 25) -> str:
    return f"""
  gs AS (SELECT target_gene, count(*) AS n_cells FROM cells GROUP BY 1 HAVING count(*) >= {min_cells}),
  dense AS (SELECT target_gene, n_cells, gene, coalesce(value, 0.0) AS value FROM gs JOIN cells USING (target_gene) CROSS JOIN genes LEFT JOIN expr USING (cell_id, gene)),
  prof AS (SELECT target_gene, gene, {value} AS value, n_cells, CAST(0 AS BIGINT) AS replicate FROM dense GROUP BY target_gene, gene, n_cells)"""


def _profile(how: str):
    def run(spark, d):
        m = T.count_matrix(spark, d)
        rows = P.group_profiles(C.labelled(m), m.cells, m.genes, ["target_gene"], how)
        return rows.withColumn("value", r6("value"))

    return run


for _how, _sql in (("sum", "sum(value)"), ("mean", "avg(value)"), ("median", "median(value)")):
    query(f"pb_{_how}", f"WITH {CELLS}, {EXPR}, {GENES}, {profile_sql(_sql)} SELECT * REPLACE (round(value, 6) + 0.0 AS value) FROM prof")(_profile(_how))


BOOT_SQL = """
  gs AS (SELECT target_gene, count(*) AS n_cells FROM cells GROUP BY 1 HAVING count(*) >= 25),
  pool AS (SELECT target_gene, cell_id, row_number() OVER (PARTITION BY target_gene ORDER BY md5('pool0:' || cell_id), cell_id) - 1 AS pool_idx FROM cells),
  draws AS (SELECT target_gene, replicate, CAST('0x' || substr(md5('draw0:' || target_gene || ':' || replicate || ':' || i), 1, 15) AS BIGINT) % n_cells AS pool_idx
            FROM (SELECT target_gene, n_cells, replicate, unnest(range(n_cells)) AS i FROM gs, (VALUES (0), (1), (2)) r(replicate)) x),
  summed AS (SELECT target_gene, replicate, gene, sum(value) AS value FROM draws JOIN pool USING (target_gene, pool_idx) JOIN expr USING (cell_id) GROUP BY 1, 2, 3)
SELECT target_gene, CAST(replicate AS BIGINT) AS replicate, gene, n_cells, coalesce(value, 0.0) AS value
FROM gs CROSS JOIN (VALUES (0), (1), (2)) r(replicate) CROSS JOIN genes LEFT JOIN summed USING (target_gene, replicate, gene)"""


@query("pb_bootstrap", f"WITH {CELLS}, {EXPR}, {GENES}, {BOOT_SQL}")
def pb_bootstrap(spark, d):
    m = T.count_matrix(spark, d)
    return P.bootstrap_profiles(m.expr, m.cells, m.genes, ["target_gene"], 3)


BATCH_PROFILES = """
  bsize AS (SELECT target_gene, batch, count(*) AS n FROM cells GROUP BY 1, 2),
  bprof AS (SELECT target_gene, batch, gene, coalesce(s, 0) / n AS value FROM bsize CROSS JOIN genes
            LEFT JOIN (SELECT target_gene, batch, gene, sum(value) AS s FROM logged GROUP BY 1, 2, 3) q USING (target_gene, batch, gene))"""


def batch_profiles(spark, d) -> DataFrame:
    m, logged = logged_matrix(spark, d)
    return materialized(P.group_profiles(logged, m.cells, m.genes, ["target_gene", "batch"], "mean", min_cells=0), "profiles")


@query("control_profile", f"""
WITH {MATRIX_LOG}, {BATCH_PROFILES} SELECT gene, round(avg(value), 6) + 0.0 AS control FROM bprof WHERE target_gene = 'non-targeting' GROUP BY 1""")
def control_profile(spark, d):
    return P.control_profile(batch_profiles(spark, d)).withColumn("control", r6("control"))


@query("delta_vs_control", f"""
WITH {MATRIX_LOG}, {BATCH_PROFILES}, mean AS (SELECT target_gene, gene, avg(value) AS m FROM bprof GROUP BY 1, 2)
SELECT p.target_gene, p.gene, round(p.m - c.m, 6) + 0.0 AS delta FROM mean p JOIN mean c ON c.gene = p.gene AND c.target_gene = 'non-targeting'
WHERE p.target_gene <> 'non-targeting'""")
def delta_vs_control(spark, d):
    return P.delta_vs_control(batch_profiles(spark, d)).withColumn("delta", r6("delta"))


@query("gene_moments", f"""
WITH {MATRIX_LOG}, n AS (SELECT count(*) AS n FROM cells)
SELECT gene, round(coalesce(sum(value), 0) / any_value(n), 6) + 0.0 AS mean,
  round(greatest(coalesce(sum(value * value), 0) / any_value(n) - power(coalesce(sum(value), 0) / any_value(n), 2), 0), 6) + 0.0 AS variance
FROM genes CROSS JOIN n LEFT JOIN logged USING (gene) GROUP BY 1""")
def gene_moments(spark, d):
    m, logged = logged_matrix(spark, d)
    return P.gene_moments(logged, m.cells, m.genes).select("gene", r6("mean").alias("mean"), r6("variance").alias("variance"))


VARIANCE_SQL = """
  v AS (SELECT held, avg(greatest(ss / n - (s / n) * (s / n), 0)) AS mean_var FROM (
    SELECT c.held, gene, n, coalesce(s, 0) AS s, coalesce(ss, 0) AS ss
    FROM (SELECT context = '1-URGENT' AS held, count(*) AS n FROM cells WHERE target_gene <> 'non-targeting' GROUP BY 1) c CROSS JOIN genes
    LEFT JOIN (SELECT context = '1-URGENT' AS held, gene, sum(value) AS s, sum(value * value) AS ss FROM logged WHERE target_gene <> 'non-targeting' GROUP BY 1, 2) q
    USING (held, gene)) x GROUP BY 1)"""


@query("variance_inflation", f"""
WITH {MATRIX_LOG}, {VARIANCE_SQL}, r AS (SELECT max(mean_var) FILTER (NOT held) / max(mean_var) FILTER (held) AS q FROM v)
SELECT round(q, 6) AS variance_ratio, q > 1.0 AS flagged FROM r""")
def variance_inflation(spark, d):
    m, logged = logged_matrix(spark, d)
    held = F.col("context") == HELD_OUT
    pred = Q.mean_gene_variance(logged.filter(~held), m.cells.filter(~held), m.genes)
    real = Q.mean_gene_variance(logged.filter(held), m.cells.filter(held), m.genes)
    return Q.variance_inflation(pred, real, tolerance=1.0).withColumn("variance_ratio", r6("variance_ratio"))


# -- models ----------------------------------------------------------------------------------


@query("mean_perturbation_delta", f"WITH {MATRIX_LOG}, {RUNG0B_SQL} SELECT gene_pos, gene, round(delta, 6) + 0.0 AS delta FROM rung0b")
def mean_perturbation_delta(spark, d):
    m, logged = logged_matrix(spark, d)
    return R.mean_perturbation_delta(P.label_moments(logged, m.cells, m.genes)).withColumn("delta", r6("delta"))


FEATURES = """
  feat AS (SELECT gene_pos, gene, avg(delta) AS mean_delta, avg(CASE WHEN abs(z) > 1 THEN 1.0 ELSE 0 END) AS deg_frequency,
             max(m_c) AS mean_expression, max(v_c) AS gene_variance, avg(abs(delta)) AS effect_size_prior FROM tdelta GROUP BY 1, 2),
  kd AS (SELECT coalesce(avg(delta), 0) AS knockdown, count(*) AS n_self FROM tdelta WHERE gene = target_gene)"""


def fitted_deltas(spark, d) -> DataFrame:
    m, logged = logged_matrix(spark, d)
    return R.training_deltas(materialized(P.label_moments(logged, m.cells, m.genes), "moments"))


@query("backbone_features", f"""
WITH {MATRIX_LOG}, {LABEL_STATS}, {FEATURES} SELECT gene, round(mean_delta, 6) + 0.0 AS mean_delta, round(deg_frequency, 6) + 0.0 AS deg_frequency,
  round(mean_expression, 6) AS mean_expression, round(gene_variance, 6) AS gene_variance, round(effect_size_prior, 6) AS effect_size_prior FROM feat""")
def backbone_features(spark, d):
    names = ("mean_delta", "deg_frequency", "mean_expression", "gene_variance", "effect_size_prior")
    return R.backbone_features(fitted_deltas(spark, d), deg_z=1.0).select("gene", *[r6(c).alias(c) for c in names])


@query("mean_self_knockdown", f"WITH {MATRIX_LOG}, {LABEL_STATS}, {FEATURES} SELECT round(knockdown, 6) + 0.0 AS knockdown, n_self FROM kd")
def mean_self_knockdown(spark, d):
    return R.mean_self_knockdown(fitted_deltas(spark, d)).withColumn("knockdown", r6("knockdown"))


@query("backbone_delta", f"""
WITH {MATRIX_LOG}, {LABEL_STATS}, {FEATURES}, {TARGETS}
SELECT target_gene, gene, round(CASE WHEN gene = target_gene THEN knockdown ELSE deg_frequency * mean_delta END, 6) + 0.0 AS delta
FROM targets CROSS JOIN feat CROSS JOIN kd""")
def backbone_delta(spark, d):
    deltas = fitted_deltas(spark, d)
    out = R.backbone_delta(targets(spark, d), R.backbone_features(deltas, deg_z=1.0), R.mean_self_knockdown(deltas))
    return out.select("target_gene", "gene", r6("delta").alias("delta"))


@query("context_profile", f"""
WITH {MATRIX}, {PROFILE_SQL}, n AS (SELECT context, count(DISTINCT cell_id) AS n_cells FROM ctrl GROUP BY 1)
SELECT context, gene, round(fraction, 6) + 0.0 AS fraction, depth, n_cells FROM prof JOIN depth USING (context) JOIN n USING (context)""")
def context_profile(spark, d):
    m = C.rows_written(T.count_matrix(spark, d))
    profile, libsizes = emit.context_profile(C.labelled(m), m.genes)
    sizes = libsizes.groupBy("context").agg(F.count("*").alias("n_cells"))
    return profile.join(emit.median_depth(libsizes), "context").join(sizes, "context").select(
        "context", "gene", r6("fraction").alias("fraction"), "depth", "n_cells"
    )


# -- effects and transfer --------------------------------------------------------------------

SOURCE_EFFECTS = """
  csize AS (SELECT context, target_gene, count(DISTINCT cell_id) AS n FROM entries WHERE context <> '1-URGENT' GROUP BY 1, 2),
  ccpm AS (SELECT context, target_gene, gene, sum(value / libsize * 1e6) AS s, sum((value / libsize * 1e6) * (value / libsize * 1e6)) AS ss FROM entries GROUP BY 1, 2, 3),
  cmv AS (SELECT context, target_gene, gene, n, coalesce(s, 0) / n AS m, greatest(coalesce(ss, 0) / n - (coalesce(s, 0) / n) * (coalesce(s, 0) / n), 0) AS v
          FROM csize CROSS JOIN genes LEFT JOIN ccpm USING (context, target_gene, gene)),
  eff AS (SELECT p.context, p.target_gene, p.gene, log2((p.m + 1) / (c.m + 1)) AS fc,
            (p.v / p.n / power(p.m + 1, 2) + c.v / c.n / power(c.m + 1, 2)) / power(ln(2), 2) AS var
          FROM cmv p JOIN cmv c ON c.context = p.context AND c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting')"""
POOLED = f"""
  pooled AS (SELECT target_gene, gene, sum({SHRUNK} / greatest(var, 1e-6)) / sum(1 / greatest(var, 1e-6)) AS pooled FROM eff GROUP BY 1, 2)"""


def source_effects(spark, d, *, again: bool = False) -> tuple[CountMatrix, DataFrame]:
    """Effects per source context, the held-out context left out. ``again``: the caller passes over the entries, too."""
    m = C.rows_written(T.count_matrix(spark, d)) if again else T.count_matrix(spark, d)
    pb = P.label_sums(m.where(F.col("context") != HELD_OUT), by=("context", "target_gene"), save=True)
    return m, FX.log2fc_with_var(pb, m.genes)


@query("log2fc_with_var", f"WITH {MATRIX}, {SOURCE_EFFECTS} SELECT context, target_gene, gene, round(fc, 6) + 0.0 AS log2fc, round(var, 6) + 0.0 AS var FROM eff")
def log2fc_with_var(spark, d):
    _, effects = source_effects(spark, d)
    return effects.select("context", "target_gene", "gene", r6("log2fc").alias("log2fc"), r6("var").alias("var"))


GENERIC = "generic AS (SELECT gene, avg(fc) AS shift FROM eff WHERE context = '2-HIGH' GROUP BY 1)"


@query("mean_shift", f"WITH {MATRIX}, {SOURCE_EFFECTS}, {GENERIC} SELECT gene, round(shift, 6) + 0.0 AS shift FROM generic")
def mean_shift(spark, d):
    m, effects = source_effects(spark, d)
    return FX.mean_shift(effects.filter(F.col("context") == "2-HIGH"), m.genes).withColumn("shift", r6("shift"))


@query("pool_inverse_variance", f"""
WITH {MATRIX}, {SOURCE_EFFECTS}, {POOLED}, {TARGETS}, cov AS (SELECT DISTINCT target_gene, true AS c FROM eff)
SELECT target_gene, gene, coalesce(c, false) AS covered, CASE WHEN c THEN round(coalesce(pooled, 0), 6) + 0.0 END AS pooled
FROM targets CROSS JOIN genes LEFT JOIN cov USING (target_gene) LEFT JOIN pooled USING (target_gene, gene)""")
def pool_inverse_variance(spark, d):
    m, effects = source_effects(spark, d)
    return FX.pooled_for_targets(targets(spark, d), effects, m.genes).select("target_gene", "gene", "covered", r6("pooled").alias("pooled"))


TRANSFER = """
SELECT target_gene, gene, c IS NOT NULL AS covered, round(CASE WHEN gene = target_gene {own} THEN -2.32 ELSE 0.9 * {value} END, 6) + 0.0 AS shift
FROM targets CROSS JOIN genes JOIN generic USING (gene) LEFT JOIN (SELECT DISTINCT target_gene, true AS c FROM eff) v USING (target_gene)
LEFT JOIN pooled USING (target_gene, gene)"""


@query("transfer_delta", f"WITH {MATRIX}, {SOURCE_EFFECTS}, {GENERIC}, {POOLED}, {TARGETS} " + TRANSFER.format(own="", value="coalesce(pooled, shift)"))
def transfer_delta(spark, d):
    m, effects = source_effects(spark, d)
    generic = FX.mean_shift(effects.filter(F.col("context") == "2-HIGH"), m.genes)
    out = FX.transfer_delta(targets(spark, d), effects, m.genes, fallback=generic, alpha=0.9)
    return out.select("target_gene", "gene", "covered", r6("shift").alias("shift"))


@query("transfer_delta_no_fallback", f"WITH {MATRIX}, {SOURCE_EFFECTS}, {GENERIC}, {POOLED}, {TARGETS} " + TRANSFER.format(own="AND c", value="pooled"))
def transfer_delta_no_fallback(spark, d):
    m, effects = source_effects(spark, d)
    return FX.transfer_delta(targets(spark, d), effects, m.genes, alpha=0.9).select("target_gene", "gene", "covered", r6("shift").alias("shift"))


# -- dataset statistics ----------------------------------------------------------------------


@query("profile_dataset", f"""
WITH {CELLS}, {GENES}, n AS (SELECT target_gene, count(*) AS n FROM cells GROUP BY 1), p AS (SELECT * FROM n WHERE target_gene <> 'non-targeting')
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM n) AS n_cells, (SELECT count(*) FROM genes) AS n_genes, count(*) AS n_perturbations,
  (SELECT n FROM n WHERE target_gene = 'non-targeting') AS n_control_cells,
  round((SELECT n FROM n WHERE target_gene = 'non-targeting') / (SELECT sum(n) FROM n), 6) AS control_fraction,
  min(n) AS min_cells, quantile_cont(n, 0.25) AS p25_cells, quantile_cont(n, 0.5) AS median_cells, quantile_cont(n, 0.75) AS p75_cells, max(n) AS max_cells,
  count(*) FILTER (n >= 10) AS perts_ge_10, count(*) FILTER (n >= 30) AS perts_ge_30, count(*) FILTER (n >= 50) AS perts_ge_50, count(*) FILTER (n >= 100) AS perts_ge_100,
  count(*) FILTER (target_gene IN (SELECT gene FROM genes)) AS n_perts_measured,
  (SELECT count(DISTINCT context) FROM cells) AS n_unique_context, (SELECT count(DISTINCT batch) FROM cells) AS n_unique_batch FROM p""")
def profile_dataset(spark, d):
    return PR.profile_dataset(T.count_matrix(spark, d)).withColumn("control_fraction", r6("control_fraction"))


@query("profile_matrix", f"""
WITH {CELLS}, {EXPR}, {GENES}, pc AS (SELECT c.cell_id, coalesce(sum(value), 0) AS total, count(value) AS det, coalesce(max(value), 0) AS top
  FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY 1)
SELECT (SELECT bool_and(value = round(value)) FROM expr) AS integral_counts, max(top) AS value_max, min(total) AS umi_min, median(total) AS umi_median, max(total) AS umi_max,
  median(det) AS median_genes_detected, round(100 * (1 - sum(det) / (count(*) * (SELECT count(*) FROM genes))), 6) AS pct_zeros FROM pc""")
def profile_matrix(spark, d):
    return PR.profile_matrix(T.count_matrix(spark, d)).withColumn("pct_zeros", r6("pct_zeros"))


@query("profile_overlap", f"""
WITH {CELLS}, {TARGETS}, t AS (SELECT DISTINCT target_gene FROM cells WHERE target_gene <> 'non-targeting')
SELECT (SELECT count(*) FROM t) AS n_train, (SELECT count(*) FROM targets) AS n_validation, (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM targets) i) AS n_shared""")
def profile_overlap(spark, d):
    train = T.cells(spark, d).filter(F.col("target_gene") != CONTROL).select("target_gene").distinct()
    wanted = targets(spark, d)
    count = lambda df: df.agg(F.count("*").alias("n"))
    return count(train).withColumnRenamed("n", "n_train").withColumn("n_validation", count(wanted).scalar()).withColumn(
        "n_shared", count(PR.shared_labels(train, wanted)).scalar()
    )


STATE_SQL = """SELECT '{name}' AS matrix, count(*) AS n_cells, least(min(lo), 0) AS min_value, bool_and(whole) AS integral,
  CASE WHEN min(lo) < 0 OR max(total) - min(total) <= 1e-8 + 1e-5 * min(total) OR NOT bool_and(whole) THEN 'transformed' ELSE 'raw_counts' END AS state
  FROM ({rows}) r"""
COUNT_ROWS = "SELECT c.cell_id, coalesce(sum(value), 0) AS total, coalesce(min(value), 0) AS lo, coalesce(bool_and(abs(value - round(value)) <= 1e-8), true) AS whole FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY 1"
CP10K_ROWS = "SELECT cell_id, 1e4 AS total, min(value) AS lo, bool_and(abs(value / libsize * 1e4 - round(value / libsize * 1e4)) <= 1e-8 + 1e-5 * round(value / libsize * 1e4)) AS whole FROM expr JOIN lib USING (cell_id) GROUP BY 1"
VECTOR_ROWS = "SELECT vec_id, sum(v) AS total, min(v) AS lo, bool_and(abs(v - round(v)) <= 1e-8) AS whole FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) u GROUP BY 1"


def _three_matrices(spark, d) -> list[tuple[str, DataFrame, DataFrame]]:
    m = T.count_matrix(spark, d)
    cp10k = C.scaled(C.with_libsize(m.expr), 1e4)
    vectors = T.table(spark, d, "embeddings")
    dense = unpack_dense(vectors, "vec_id", "embedding")
    return [
        ("counts", m.expr, m.cells), ("cp10k", cp10k, cp10k.select("cell_id").distinct()),
        ("embeddings", dense, vectors.select(F.col("vec_id").alias("cell_id"))),
    ]


THREE_STATES = f"""WITH {CELLS}, {EXPR}, {LIB}, states AS (
{STATE_SQL.format(name='counts', rows=COUNT_ROWS)} UNION ALL
SELECT matrix, n_cells, 0.0 AS min_value, integral, state FROM ({STATE_SQL.format(name='cp10k', rows=CP10K_ROWS)}) k UNION ALL
SELECT matrix, n_cells, round(min_value, 6), integral, state FROM ({STATE_SQL.format(name='embeddings', rows=VECTOR_ROWS)}) e)"""


@query("detect_counts_state", f"{THREE_STATES} SELECT * FROM states")
def detect_counts_state(spark, d):
    out = None
    for name, expr, cells in _three_matrices(spark, d):
        row = C.counts_state(expr, cells).select(F.lit(name).alias("matrix"), "n_cells", r6("min_value").alias("min_value"), "integral", "state")
        out = row if out is None else out.unionByName(row)
    return out


@query("assert_raw_counts", f"{THREE_STATES} SELECT matrix, state = 'raw_counts' AS accepted FROM states")
def assert_raw_counts(spark, d):
    verdicts = []
    genes = T.genes(spark, d)
    for name, expr, cells in _three_matrices(spark, d):
        try:
            C.require_raw_counts(CountMatrix(cells, genes, expr), "assert_raw_counts")
            verdicts.append((name, True))
        except ValueError:
            verdicts.append((name, False))
    return spark.createDataFrame(verdicts, "matrix string, accepted boolean")


@query("count_labels", f"WITH {CELLS} SELECT target_gene, count(*) AS n_cells FROM cells GROUP BY 1")
def count_labels(spark, d):
    return S.count_labels(T.cells(spark, d))


@query("distinct_labels", f"WITH {CELLS} SELECT DISTINCT target_gene FROM cells")
def distinct_labels(spark, d):
    return PR.distinct_labels(T.cells(spark, d))


@query("subset_report", f"""
WITH {CELLS}, {GENES}, n AS (SELECT target_gene, count(*) AS n FROM cells GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_cells, count(*) AS n_labels, min(n) AS min_per_label, median(n) AS median_per_label, (SELECT count(*) FROM genes) AS n_genes FROM n""")
def subset_report(spark, d):
    return PR.subset_report(T.cells(spark, d), T.genes(spark, d))


@query("pool_chunk_embeddings", """
SELECT key, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) + 0.0 AS value FROM (
  SELECT label AS key, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) u GROUP BY 1, 2""")
def pool_chunk_embeddings(spark, d):
    return E.pool_chunks(T.table(spark, d, "embeddings").withColumnRenamed("label", "key"), "key", "embedding").withColumn("value", r6("value"))
