"""Queries: differential expression, scores, anchors, guardrails."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from pertmatrix.matrix import CountMatrix
from pertmatrix.operators import cells as C, effects as FX, expression, metrics as Q, predictors as R, pseudobulk as P
from pertmatrix.plans import evaluation as EV
from pertmatrix.plans.q_aggregates import logged_matrix
from pertmatrix.plans.q_cells import HELD_OUT, RUNG0B_SQL
from pertmatrix.plans.q_joins import TARGETS, targets
from pertmatrix.plans.q_sources import CONTEXTS, WILCOXON_SQL
from pertmatrix.plans.registry import MATRIX, MATRIX_LOG, query, r6
from pertmatrix.session import materialized
from pertmatrix.sources import testdata as T

Z = 1.0

# -- rank tests ------------------------------------------------------------------------------


@query("de_wilcoxon", f"WITH {MATRIX}, {WILCOXON_SQL} SELECT target_gene, gene, n_pert, n_ctrl, u, round(z, 6) + 0.0 AS z FROM de")
def de_wilcoxon(spark, d):
    m = T.count_matrix(spark, d)
    return expression.wilcoxon(C.labelled(m), m.cells, m.genes).withColumn("z", r6("z"))


# erf as its positive series: 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!
P_VALUE = """
  pv AS (SELECT target_gene, gene, z, CASE WHEN z = 0 THEN 1.0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(300),
      lambda n: exp((2 * n + 1) * ln(abs(z) / sqrt(2)) + n * ln(2) - (ln(2) * (n + 1) + lgamma(n + 1.5) - 0.5 * ln(pi())))))) END AS p FROM de),
  rk AS (SELECT *, p * count(*) OVER (PARTITION BY target_gene) / row_number() OVER (PARTITION BY target_gene ORDER BY p, gene) AS q FROM pv)"""


@query("de_bh_fdr", f"""
WITH {MATRIX}, {WILCOXON_SQL}, {P_VALUE}
SELECT target_gene, gene, round(z, 6) + 0.0 AS z, round(p, 6) + 0.0 AS p,
  round(least(1, min(q) OVER (PARTITION BY target_gene ORDER BY p DESC, gene DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0 AS fdr FROM rk""")
def de_bh_fdr(spark, d):
    m = T.count_matrix(spark, d)
    tests = expression.with_fdr(expression.wilcoxon(C.labelled(m), m.cells, m.genes))
    return tests.select("target_gene", "gene", r6("z").alias("z"), r6("p").alias("p"), r6("fdr").alias("fdr"))


# -- errors and discrimination, every context held out once ----------------------------------

HOLD_OUT = """
  held AS (SELECT DISTINCT context AS held FROM cells),
  sided AS (SELECT held, target_gene, cell_id, CASE WHEN context = held THEN 'real' ELSE 'pred' END AS side FROM cells CROSS JOIN held),
  hsize AS (SELECT held, side, target_gene, count(*) AS n FROM sided GROUP BY 1, 2, 3),
  hsum AS (SELECT s.held, s.side, s.target_gene, gene, sum(value) AS v FROM sided s JOIN logged USING (cell_id) GROUP BY 1, 2, 3, 4),
  hmean AS (SELECT held, side, target_gene, gene, coalesce(v, 0) / n AS m FROM hsize CROSS JOIN genes LEFT JOIN hsum USING (held, side, target_gene, gene)),
  hdelta AS (SELECT p.held, p.side, p.target_gene, p.gene, p.m - c.m AS delta FROM hmean p JOIN hmean c
             ON c.held = p.held AND c.side = p.side AND c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting')"""
HELD_PAIRS = f"""{HOLD_OUT},
  preds AS (SELECT held AS k, target_gene, gene, delta FROM hdelta WHERE side = 'pred'),
  reals AS (SELECT held AS k, target_gene, gene, delta FROM hdelta WHERE side = 'real')"""
SCORES = """
  errs AS (SELECT k, target_gene, avg(abs(p.delta - r.delta)) AS mae, avg(power(p.delta - r.delta, 2)) AS mse,
             CASE WHEN max(p.delta) = min(p.delta) OR max(r.delta) = min(r.delta) THEN NULL ELSE corr(p.delta, r.delta) END AS pearson_delta
           FROM preds p JOIN reals r USING (k, target_gene, gene) GROUP BY 1, 2),
  dist AS (SELECT p.k, p.target_gene, r.target_gene AS other, round(sum(abs(p.delta - r.delta)), 9) AS l1,
             round(1 - CASE WHEN sum(p.delta * p.delta) > 0 AND sum(r.delta * r.delta) > 0 THEN sum(p.delta * r.delta) / sqrt(sum(p.delta * p.delta)) / sqrt(sum(r.delta * r.delta)) ELSE 0 END, 9) AS cosine
           FROM preds p JOIN reals r ON r.k = p.k AND r.gene = p.gene GROUP BY 1, 2, 3),
  pds AS (SELECT a.k, a.target_gene, count(*) AS n_real, count(*) FILTER (b.l1 < a.l1) AS closer_l1, count(*) FILTER (b.cosine < a.cosine) AS closer_cosine
          FROM dist a JOIN dist b ON b.k = a.k AND b.target_gene = a.target_gene WHERE a.other = a.target_gene GROUP BY 1, 2),
  scores AS (SELECT k, target_gene, 'mae' AS metric, mae AS value FROM errs UNION ALL SELECT k, target_gene, 'mse', mse FROM errs
    UNION ALL SELECT k, target_gene, 'pearson_delta', pearson_delta FROM errs
    UNION ALL SELECT k, target_gene, 'pds_l1', 1 - closer_l1 / n_real FROM pds UNION ALL SELECT k, target_gene, 'pds_cosine', 1 - closer_cosine / n_real FROM pds),
  means AS (SELECT k, metric, avg(value) AS value FROM scores GROUP BY 1, 2)"""


def sums_of(spark, d) -> EV.ContextSums:
    m, logged = logged_matrix(spark, d)
    return EV.context_sums(logged, m.cells, m.genes)


def held_pair(spark, d) -> EV.Scored:
    return EV.hold_out_each_context(sums_of(spark, d), T.contexts(spark, d))


def _error_metric(name: str):
    def run(spark, d):
        pair = held_pair(spark, d)
        errors = Q.error_metrics(Q.paired(pair.pred, pair.real, ["context"]), ["context"])
        return errors.select("context", "target_gene", r6(name).alias(name))

    query(f"metric_{name}", f"WITH {MATRIX_LOG}, {HELD_PAIRS}, {SCORES} SELECT k AS context, target_gene, round({name}, 6) + 0.0 AS {name} FROM errs")(run)


for _name in ("mae", "mse", "pearson_delta"):
    _error_metric(_name)


def _discrimination(kind: str):
    def run(spark, d):
        pair = held_pair(spark, d)
        return Q.discrimination(pair.pred, pair.real, [kind], ["context"]).drop("kind").withColumn("score", r6("score"))

    query(f"metric_pds_{kind}", f"""WITH {MATRIX_LOG}, {HELD_PAIRS}, {SCORES}
SELECT k AS context, target_gene, n_real, closer_{kind} AS n_closer, round(1 - closer_{kind} / n_real, 6) AS score FROM pds""")(run)


for _kind in ("l1", "cosine"):
    _discrimination(_kind)


@query("join_pred_real_pairs", f"""
WITH {MATRIX_LOG}, {HELD_PAIRS}, {SCORES} SELECT k AS context, count(*) AS n_labels, CAST(sum(n_real) AS BIGINT) AS n_pairs, CAST(sum(closer_l1) AS BIGINT) AS n_closer FROM pds GROUP BY 1""")
def join_pred_real_pairs(spark, d):
    pair = held_pair(spark, d)
    return Q.discrimination(pair.pred, pair.real, ["l1"], ["context"]).groupBy("context").agg(
        F.count("*").alias("n_labels"), F.sum("n_real").alias("n_pairs"), F.sum("n_closer").alias("n_closer")
    )


# -- significance metrics: prediction cells are those of the other contexts -------------------

SIDE_TESTS = """
  sc AS (SELECT cell_id, target_gene, CASE WHEN context = '1-URGENT' THEN 'real' ELSE 'pred' END AS side FROM cells),
  sl AS (SELECT side, target_gene, count(*) AS n FROM sc GROUP BY 1, 2),
  sst AS (SELECT side, s.target_gene, gene, value, count(*) AS k FROM sc s JOIN entries USING (cell_id) GROUP BY 1, 2, 3, 4),
  sh AS (SELECT * FROM sst UNION ALL SELECT side, target_gene, gene, 0.0, n - coalesce(k, 0) FROM sl CROSS JOIN genes
    LEFT JOIN (SELECT side, target_gene, gene, sum(k) AS k FROM sst GROUP BY 1, 2, 3) q USING (side, target_gene, gene) WHERE n - coalesce(k, 0) > 0),
  sp AS (SELECT p.side, p.target_gene, h.gene, h.value, sum(CASE WHEN h.target_gene = p.target_gene THEN k ELSE 0 END) AS kp, sum(k) AS t
    FROM sl p JOIN sh h ON h.side = p.side AND h.target_gene IN (p.target_gene, 'non-targeting') WHERE p.target_gene <> 'non-targeting' GROUP BY 1, 2, 3, 4),
  sr AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY side, target_gene, gene ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS mid FROM sp),
  sw AS (SELECT side, target_gene, gene, sum(kp * mid) AS w, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM sr GROUP BY 1, 2, 3),
  sv AS (SELECT w.side, w.target_gene, gene, w.w - p.n * (p.n + 1) / 2.0 - CAST(p.n AS DOUBLE) * c.n / 2.0 AS excess,
           CAST(p.n AS DOUBLE) * c.n / 12.0 * ((p.n + c.n + 1) - ties / (CAST(p.n + c.n AS DOUBLE) * (p.n + c.n - 1))) AS spread
         FROM sw w JOIN sl p ON p.side = w.side AND p.target_gene = w.target_gene JOIN sl c ON c.side = w.side AND c.target_gene = 'non-targeting'),
  sz AS (SELECT side, target_gene, gene, CASE WHEN spread > 0 THEN excess / sqrt(spread) ELSE 0 END AS z FROM sv),
  pr AS (SELECT target_gene, gene, p.z AS z_p, r.z AS z_r, abs(p.z) > 1 AS sig_p, abs(r.z) > 1 AS sig_r,
           row_number() OVER (PARTITION BY target_gene ORDER BY round(abs(p.z), 9) DESC, gene) AS rank_p,
           row_number() OVER (PARTITION BY target_gene ORDER BY round(abs(r.z), 9) DESC, gene) AS rank_r
         FROM (SELECT * FROM sz WHERE side = 'pred') p JOIN (SELECT * FROM sz WHERE side = 'real') r USING (target_gene, gene))"""


def sided(m: CountMatrix) -> DataFrame:
    return m.cells.withColumn("side", F.when(F.col("context") == HELD_OUT, "real").otherwise("pred"))


def significance(spark, d) -> DataFrame:
    m = T.count_matrix(spark, d)
    cells = sided(m)
    tests = materialized(expression.wilcoxon(C.labelled(CountMatrix(cells, m.genes, m.expr)), cells, m.genes, by=["side"]), "tests")
    return Q.significance_pairs(tests.filter("side = 'pred'"), tests.filter("side = 'real'"), Z)


def _overlap(key: str, sig: str):
    def run(spark, d):
        return Q.overlap_at(significance(spark, d), sig).withColumn("value", r6("value"))

    query(key, f"""WITH {MATRIX}, {SIDE_TESTS}, n AS (SELECT *, count(*) FILTER ({sig}) OVER (PARTITION BY target_gene) AS n FROM pr)
SELECT target_gene, max(n) AS n, count(*) FILTER (rank_p <= n AND rank_r <= n) AS n_shared,
  CASE WHEN max(n) > 0 THEN round(count(*) FILTER (rank_p <= n AND rank_r <= n) / max(n), 6) END AS value FROM n GROUP BY 1""")(run)


_overlap("metric_overlap_at_n", "sig_r")
_overlap("metric_precision_at_n", "sig_p")


@query("metric_nsig", f"""WITH {MATRIX}, {SIDE_TESTS}
SELECT target_gene, count(*) FILTER (sig_p) AS nsig_pred, count(*) FILTER (sig_r) AS nsig_real FROM pr GROUP BY 1""")
def metric_nsig(spark, d):
    return Q.n_significant(significance(spark, d))


@query("metric_sig_jaccard", f"""WITH {MATRIX}, {SIDE_TESTS}
SELECT target_gene, count(*) FILTER (sig_p AND sig_r) AS both, count(*) FILTER (sig_p OR sig_r) AS either,
  CASE WHEN count(*) FILTER (sig_p OR sig_r) > 0 THEN round(count(*) FILTER (sig_p AND sig_r) / count(*) FILTER (sig_p OR sig_r), 6) END AS value FROM pr GROUP BY 1""")
def metric_sig_jaccard(spark, d):
    return Q.significance_jaccard(significance(spark, d)).withColumn("value", r6("value"))


@query("metric_direction_agreement", f"""WITH {MATRIX}, {SIDE_TESTS}
SELECT target_gene, count(*) FILTER (sig_r AND sign(z_p) = sign(z_r)) AS same, count(*) FILTER (sig_r) AS n,
  CASE WHEN count(*) FILTER (sig_r) > 0 THEN round(count(*) FILTER (sig_r AND sign(z_p) = sign(z_r)) / count(*) FILTER (sig_r), 6) END AS value FROM pr GROUP BY 1""")
def metric_direction_agreement(spark, d):
    return Q.direction_agreement(significance(spark, d)).withColumn("value", r6("value"))


@query("metric_lfc_nmae", f"""
WITH {MATRIX}, {SIDE_TESTS},
  fn AS (SELECT side, s.target_gene, count(DISTINCT cell_id) AS n FROM sc s JOIN entries USING (cell_id) GROUP BY 1, 2),
  fs AS (SELECT side, s.target_gene, gene, sum(value / libsize * 1e6) AS s FROM sc s JOIN entries USING (cell_id) GROUP BY 1, 2, 3),
  fm AS (SELECT side, target_gene, gene, coalesce(s, 0) / n AS m FROM fn CROSS JOIN genes LEFT JOIN fs USING (side, target_gene, gene)),
  fc AS (SELECT p.side, p.target_gene, p.gene, log2((p.m + 1) / (c.m + 1)) AS lfc FROM fm p JOIN fm c ON c.side = p.side AND c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting')
SELECT target_gene, round(sum(abs(p.lfc - r.lfc)) / sum(abs(r.lfc)), 6) AS value
FROM pr JOIN (SELECT * FROM fc WHERE side = 'pred') p USING (target_gene, gene) JOIN (SELECT * FROM fc WHERE side = 'real') r USING (target_gene, gene)
WHERE sig_r GROUP BY 1""")
def metric_lfc_nmae(spark, d):
    m = T.count_matrix(spark, d)
    pb = P.label_sums(CountMatrix(sided(m), m.genes, m.expr), by=("side", "target_gene"), save=True)
    lfc = FX.log2fc_with_var(pb, m.genes)
    out = Q.fold_change_error(significance(spark, d), lfc.filter("side = 'pred'"), lfc.filter("side = 'real'"))
    return out.select("target_gene", r6("value").alias("value"))


# -- aggregate scores ------------------------------------------------------------------------


def held_means(spark, d) -> DataFrame:
    return Q.metric_means(EV.delta_scores(held_pair(spark, d)), ["context"])


@query("extract_metric_means", f"""
WITH {MATRIX_LOG}, {HELD_PAIRS}, {SCORES} SELECT k AS context, metric, round(value, 6) + 0.0 AS value FROM means""")
def extract_metric_means(spark, d):
    return held_means(spark, d).withColumn("value", r6("value"))


@query("generalization_gap", f"""
WITH {MATRIX_LOG}, {HELD_PAIRS}, {SCORES}
SELECT metric, round(t.value - h.value, 6) + 0.0 AS gap FROM (SELECT metric, avg(value) AS value FROM means WHERE k <> '1-URGENT' GROUP BY 1) t
LEFT JOIN (SELECT * FROM means WHERE k = '1-URGENT' AND metric <> 'mse') h USING (metric)""")
def generalization_gap(spark, d):
    means = held_means(spark, d)
    train = means.filter(F.col("context") != HELD_OUT).groupBy("metric").agg(F.avg("value").alias("value"))
    holdout = means.filter((F.col("context") == HELD_OUT) & (F.col("metric") != "mse"))
    return Q.generalization_gap(train, holdout).withColumn("gap", r6("gap"))


@query("baseline_arm", f"WITH {MATRIX_LOG}, {RUNG0B_SQL}, {TARGETS} SELECT target_gene, gene, round(delta, 6) + 0.0 AS delta FROM targets CROSS JOIN rung0b")
def baseline_arm(spark, d):
    m, logged = logged_matrix(spark, d)
    arm = R.same_delta_for(targets(spark, d), R.mean_perturbation_delta(P.label_moments(logged, m.cells, m.genes)))
    return arm.select("target_gene", "gene", r6("delta").alias("delta"))


REPLICATE = """
  seeds AS (SELECT * FROM (VALUES ('split0'), ('split1'), ('split2'), ('split3'), ('split4')) v(k)),
  rc AS (SELECT k, cell_id, target_gene, CAST('0x' || substr(md5(k || ':' || cell_id), 1, 15) AS BIGINT) % 2 AS half FROM cells CROSS JOIN seeds),
  rn AS (SELECT k, half, target_gene, count(*) AS n FROM rc GROUP BY 1, 2, 3),
  rs AS (SELECT k, half, rc.target_gene, gene, sum(value) AS v FROM rc JOIN logged USING (cell_id) GROUP BY 1, 2, 3, 4),
  rm AS (SELECT k, half, target_gene, gene, coalesce(v, 0) / n AS m FROM rn CROSS JOIN genes LEFT JOIN rs USING (k, half, target_gene, gene)),
  rd AS (SELECT p.k, p.half, p.target_gene, p.gene, p.m - c.m AS delta FROM rm p JOIN rm c ON c.k = p.k AND c.half = p.half AND c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting'),
  preds AS (SELECT * FROM rd WHERE half = 0), reals AS (SELECT * FROM rd WHERE half = 1)"""


def halved_matrix(spark, d) -> tuple[CountMatrix, DataFrame]:
    """``logged_matrix`` with the halves of its cells, which the entries get from them."""
    m = T.count_matrix(spark, d)
    m = CountMatrix(EV.with_halves(m.cells), m.genes, m.expr)
    return m, C.log_normalized(C.labelled(m))


def replicate_means(spark, d) -> DataFrame:
    m, logged = halved_matrix(spark, d)
    return Q.metric_means(EV.delta_scores(EV.replicate_halves(logged, m.cells, m.genes)), ["context"])


@query("replicate_anchor", f"WITH {MATRIX_LOG}, {REPLICATE}, {SCORES} SELECT metric, round(avg(value), 6) + 0.0 AS value FROM means GROUP BY 1")
def replicate_anchor(spark, d):
    return replicate_means(spark, d).groupBy("metric").agg(F.avg("value").alias("value")).withColumn("value", r6("value"))


def prefixed(sql: str, prefix: str) -> str:
    """The scoring CTEs again under other names, for a second prediction in one statement."""
    return re.sub(r"\b(preds|reals|errs|dist|pds|scores|means)\b", prefix + r"\1", sql)


ANCHORS = ",\n".join([
    MATRIX_LOG, HELD_PAIRS, SCORES,
    prefixed(REPLICATE, "r_"), prefixed(SCORES, "r_"),
    """
  gen AS (SELECT c.context AS k, gene, coalesce(s_p, 0) / n_p - coalesce(s_c, 0) / n_c AS delta
    FROM (SELECT context, count(*) FILTER (target_gene <> 'non-targeting') AS n_p, count(*) FILTER (target_gene = 'non-targeting') AS n_c FROM cells GROUP BY 1) c CROSS JOIN genes
    LEFT JOIN (SELECT context, gene, sum(value) FILTER (target_gene <> 'non-targeting') AS s_p, sum(value) FILTER (target_gene = 'non-targeting') AS s_c FROM logged GROUP BY 1, 2) q USING (context, gene)),
  b_reals AS (SELECT * FROM reals), b_preds AS (SELECT k, target_gene, gene, g.delta FROM gen g JOIN reals r USING (k, gene))""",
    prefixed(SCORES, "b_"),
    """
  anchored AS (SELECT k AS context, metric, u.value AS u, b.value AS b, r.value AS r,
      CASE WHEN abs(r.value - b.value) > 1e-9 THEN (u.value - b.value) / (r.value - b.value) END AS raw
    FROM means u JOIN b_means b USING (k, metric) JOIN (SELECT metric, avg(value) AS value FROM r_means GROUP BY 1) r USING (metric)),
  scaled AS (SELECT context, metric, u, b, r, CASE WHEN metric = 'mse' THEN greatest(0, least(1, raw)) WHEN metric = 'lfc_nmae' THEN greatest(-6, raw) ELSE raw END AS scaled FROM anchored)""",
])


def anchored(spark, d) -> DataFrame:
    m, logged = halved_matrix(spark, d)
    c = EV.context_sums(logged, m.cells, m.genes)
    pair = EV.hold_out_each_context(c, T.contexts(spark, d))
    means = EV.score_arms({
        "user": pair, "base": EV.generic_response(c, pair.real), "replicate": EV.replicate_halves(logged, m.cells, c.genes),
    })
    user, base, top = (means.filter(F.col("arm") == arm).drop("arm") for arm in ("user", "base", "replicate"))
    top = top.groupBy("metric").agg(F.avg("value").alias("value"))
    return Q.scale_to_anchors(user, base, user.select("context", "metric").join(top, "metric"), ["context"])


@query("join_score_anchors", f"WITH {ANCHORS} SELECT context, metric, round(u, 6) + 0.0 AS u, round(b, 6) + 0.0 AS b, round(r, 6) + 0.0 AS r FROM scaled")
def join_score_anchors(spark, d):
    return anchored(spark, d).select("context", "metric", r6("u").alias("u"), r6("b").alias("b"), r6("r").alias("r"))


@query("score_scale_anchor", f"WITH {ANCHORS} SELECT context, metric, round(scaled, 4) + 0.0 AS scaled FROM scaled")
def score_scale_anchor(spark, d):
    return anchored(spark, d).select("context", "metric", (F.round("scaled", 4) + 0.0).alias("scaled"))


@query("score_overall", f"WITH {ANCHORS} SELECT round(avg(scaled), 4) + 0.0 AS overall, count(scaled) AS n_members FROM scaled")
def score_overall(spark, d):
    return Q.overall(anchored(spark, d)).withColumn("overall", F.round("overall", 4) + 0.0)


# -- model ladder ----------------------------------------------------------------------------

LADDER = """
  tn AS (SELECT target_gene, count(*) AS n FROM cells WHERE context <> '1-URGENT' GROUP BY 1),
  ts AS (SELECT target_gene, gene, sum(value) AS s, sum(value * value) AS ss FROM logged WHERE context <> '1-URGENT' GROUP BY 1, 2),
  tm AS (SELECT target_gene, gene, n, coalesce(s, 0) / n AS m, greatest(coalesce(ss, 0) / n - power(coalesce(s, 0) / n, 2), 0) AS v, coalesce(s, 0) AS s
         FROM tn CROSS JOIN genes LEFT JOIN ts USING (target_gene, gene)),
  td AS (SELECT p.target_gene, p.gene, p.m - c.m AS delta, (p.m - c.m) / greatest(sqrt(c.v / c.n + p.v / p.n), 1e-9) AS z
         FROM tm p JOIN tm c ON c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting' AND p.n >= 10),
  ob AS (SELECT gene, sum(s) FILTER (target_gene <> 'non-targeting') / sum(n) FILTER (target_gene <> 'non-targeting')
           - sum(s) FILTER (target_gene = 'non-targeting') / sum(n) FILTER (target_gene = 'non-targeting') AS delta FROM tm GROUP BY 1),
  ft AS (SELECT gene, avg(CASE WHEN abs(z) > 2 THEN 1.0 ELSE 0 END) * avg(delta) AS delta FROM td GROUP BY 1),
  real1 AS (SELECT target_gene, gene, delta FROM hdelta WHERE held = '1-URGENT' AND side = 'real'),
  reals AS (SELECT k, target_gene, gene, delta FROM real1 CROSS JOIN (VALUES ('rung0'), ('rung0b'), ('rung1')) m(k)),
  preds AS (SELECT 'rung0' AS k, target_gene, gene, 0.0 AS delta FROM real1 UNION ALL SELECT 'rung0b', target_gene, gene, ob.delta FROM real1 JOIN ob USING (gene)
    UNION ALL SELECT 'rung1', target_gene, gene, CASE WHEN gene = target_gene THEN (SELECT avg(delta) FROM td WHERE gene = target_gene) ELSE ft.delta END FROM real1 JOIN ft USING (gene))"""


def ladder_scores(spark, d) -> DataFrame:
    rungs = EV.ladder(sums_of(spark, d), HELD_OUT, T.contexts(spark, d))
    return EV.delta_scores(rungs).withColumnRenamed("context", "model")


@query("model_ladder_report", f"""
WITH {MATRIX_LOG}, {HOLD_OUT}, {LADDER}, {SCORES},
  rk AS (SELECT k, metric, rank() OVER (PARTITION BY metric ORDER BY round(CASE WHEN metric IN ('mae', 'mse') THEN value ELSE -value END, 9) ASC NULLS LAST) AS rank FROM means)
SELECT k AS model, round(max(value) FILTER (metric = 'mae'), 6) + 0.0 AS mae, round(max(value) FILTER (metric = 'mse'), 6) + 0.0 AS mse,
  round(max(value) FILTER (metric = 'pearson_delta'), 6) + 0.0 AS pearson_delta, round(max(value) FILTER (metric = 'pds_l1'), 6) + 0.0 AS pds_l1,
  round(max(value) FILTER (metric = 'pds_cosine'), 6) + 0.0 AS pds_cosine, round(avg(rank), 6) AS avg_rank FROM means JOIN rk USING (k, metric) GROUP BY 1""")
def model_ladder_report(spark, d):
    names = ["mae", "mse", "pearson_delta", "pds_l1", "pds_cosine"]
    report = Q.ladder_report(Q.metric_means(ladder_scores(spark, d), ["model"]), names)
    return report.select("model", *[r6(c).alias(c) for c in [*names, "avg_rank"]])


@query("guardrail_private_gain", f"""
WITH {MATRIX_LOG}, {HOLD_OUT}, {LADDER}, {SCORES},
  split AS (SELECT k, metric, CAST(substr(target_gene, 7) AS INTEGER) % 2 = 0 AS pub, avg(value) AS value FROM scores GROUP BY 1, 2, 3),
  gain AS (SELECT s.k, metric, s.pub, (s.value - b.value) * CASE WHEN metric IN ('mae', 'mse') THEN -1 ELSE 1 END AS g
           FROM split s JOIN split b USING (metric, pub) WHERE b.k = 'rung0' AND s.k <> 'rung0'),
  gains AS (SELECT k, metric, max(g) FILTER (pub) AS gp, max(g) FILTER (NOT pub) AS gq FROM gain GROUP BY 1, 2)
SELECT k AS model, metric, round(gp, 6) + 0.0 AS gain_public, round(gq, 6) + 0.0 AS gain_private, gp > 0 AND gq <= 0 AS blocked FROM gains""")
def guardrail_private_gain(spark, d):
    scores = ladder_scores(spark, d)
    public = F.substring("target_gene", 7, 10).cast("int") % 2 == 0
    means = [Q.metric_means(scores.filter(part), ["model"]) for part in (public, ~public)]
    out = Q.private_gain_guard(*means, baseline="rung0")
    return out.select("model", "metric", r6("gain_public").alias("gain_public"), r6("gain_private").alias("gain_private"), "blocked")


@query("e_distance", """
WITH v AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
  n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
  d AS (SELECT a.label AS la, b.label AS lb, a.vec_id, b.vec_id AS other, sum(power(a.x - b.x, 2)) AS sq FROM v a JOIN v b ON b.dim = a.dim AND (b.label = a.label OR b.label = 0) GROUP BY 1, 2, 3, 4),
  w AS (SELECT la AS label, sum(sq) / any_value(n * (n - 1.0)) AS within FROM d JOIN n ON label = la WHERE la = lb GROUP BY 1),
  x AS (SELECT la AS label, avg(sq) AS between_ref FROM d WHERE lb = 0 AND la <> 0 GROUP BY 1)
SELECT label, n, round(2 * between_ref - within - (SELECT within FROM w WHERE label = 0), 6) + 0.0 AS e_distance FROM x JOIN w USING (label) JOIN n USING (label)""")
def e_distance(spark, d):
    out = Q.e_distance(T.table(spark, d, "embeddings"), "label", "embedding", 0)
    return out.withColumn("e_distance", r6("e_distance"))
