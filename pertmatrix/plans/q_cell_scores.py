"""Queries: six-member scores of predicted cells, every context held out once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pertmatrix.operators import metrics as Q
from pertmatrix.plans import cell_scores as CS
from pertmatrix.plans.q_aggregates import SOURCE_EFFECTS
from pertmatrix.plans.q_cells import SHRUNK
from pertmatrix.plans.q_metrics import SCORES, SIDE_TESTS, Z
from pertmatrix.plans.q_ranking import EVEN_SQL
from pertmatrix.plans.q_sources import PROFILE_SQL
from pertmatrix.plans.registry import MATRIX, query, r6
from pertmatrix.sources import testdata as T

SPLITS = 5


def emitted_sql(prefix: str) -> str:
    """The even emission from ``<prefix>shift`` (context, target_gene, gene, shift), its steps under a prefix."""
    steps = "frac AS" + EVEN_SQL.split("frac AS", 1)[1]
    steps = steps.replace("LEFT JOIN pooled USING (target_gene, gene)", "LEFT JOIN shift_of USING (context, target_gene, gene)").replace("coalesce(pooled, 0)", "coalesce(shift, 0)")
    return re.sub(r"\b(frac|tot|spread|shift_of)\b", lambda x: prefix + {"shift_of": "shift"}.get(x[1], x[1]), steps)


TESTS = "sl AS" + SIDE_TESTS.split("sl AS", 1)[1].split(",\n  pr AS")[0].replace("JOIN entries USING", "JOIN gent USING")

MEMBERS = f"""
WITH {MATRIX}, {PROFILE_SQL}, {SOURCE_EFFECTS.replace(" WHERE context <> '1-URGENT'", "")},
  away AS (SELECT h.context, target_gene, gene, fc, var FROM eff JOIN (SELECT DISTINCT context FROM cells) h ON h.context <> eff.context),
  apool AS (SELECT context, target_gene, gene, sum({SHRUNK} / greatest(var, 1e-6)) / sum(1 / greatest(var, 1e-6)) AS pooled FROM away GROUP BY 1, 2, 3),
  req AS (SELECT context, target_gene, count(*) AS n FROM cells WHERE target_gene <> 'non-targeting' GROUP BY 1, 2),
  ushift AS (SELECT context, target_gene, gene, CASE WHEN gene = target_gene THEN -2.32 ELSE coalesce(pooled, 0) END AS shift
    FROM req JOIN (SELECT DISTINCT context, target_gene FROM apool) c USING (context, target_gene) CROSS JOIN genes LEFT JOIN apool USING (context, target_gene, gene)),
  gn AS (SELECT context, sum(n) FILTER (target_gene <> 'non-targeting') AS np, sum(n) FILTER (target_gene = 'non-targeting') AS nc FROM csize GROUP BY 1),
  gsum AS (SELECT context, gene, sum(s) FILTER (target_gene <> 'non-targeting') AS sp, sum(s) FILTER (target_gene = 'non-targeting') AS sc FROM ccpm GROUP BY 1, 2),
  bshift AS (SELECT context, target_gene, gene, log2((coalesce(sp, 0) / np + 1) / (coalesce(sc, 0) / nc + 1)) AS shift
    FROM req JOIN gn USING (context) CROSS JOIN genes LEFT JOIN gsum USING (context, gene)),
  {emitted_sql("u")}, {emitted_sql("b")},
  halves AS (SELECT cell_id, context, target_gene, 'split' || i || 'h' || (CAST('0x' || substr(md5('split' || i || ':' || cell_id), 1, 15) AS BIGINT) % 2) AS g
    FROM cells CROSS JOIN range({SPLITS}) t(i)),
  groups AS (SELECT 'real' AS g, context, target_gene, cell_id FROM cells UNION ALL SELECT g, context, target_gene, cell_id FROM halves
    UNION ALL SELECT unnest(['user', 'base']), context, target_gene, cell_id FROM cells WHERE target_gene = 'non-targeting'),
  sc AS MATERIALIZED (SELECT g || '|' || context AS side, target_gene, g || ':' || cell_id AS cell_id FROM groups
    UNION ALL SELECT g || '|' || context, target_gene, g || ':' || context || ':' || target_gene || ':' || no
    FROM (SELECT unnest(['user', 'base']) AS g, context, target_gene, no FROM (SELECT context, target_gene, unnest(range(n)) AS no FROM req) w) v),
  gval AS (SELECT g || ':' || cell_id AS cell_id, gene, value FROM groups JOIN expr USING (cell_id)
    UNION ALL SELECT 'user:' || context || ':' || target_gene || ':' || cell_no, gene, value FROM uspread
    UNION ALL SELECT 'base:' || context || ':' || target_gene || ':' || cell_no, gene, value FROM bspread),
  gent AS MATERIALIZED (SELECT *, sum(value) OVER (PARTITION BY cell_id) AS libsize FROM gval),
  {TESTS},
  arms AS (SELECT a || '|' || context AS k, p || '|' || context AS p, r || '|' || context AS r FROM (SELECT DISTINCT context FROM cells) c CROSS JOIN (
    SELECT 'user' AS a, 'user' AS p, 'real' AS r UNION ALL SELECT 'base', 'base', 'real' UNION ALL SELECT 'split' || i, 'split' || i || 'h0', 'split' || i || 'h1' FROM range({SPLITS}) t(i)) v),
  pr AS MATERIALIZED (SELECT a.k, target_gene, gene, p.z AS z_p, q.z AS z_r, abs(p.z) > {Z} AS sig_p, abs(q.z) > {Z} AS sig_r
    FROM arms a JOIN sz p ON p.side = a.p JOIN sz q USING (target_gene, gene) WHERE q.side = a.r),
  fn AS (SELECT side, s.target_gene, count(DISTINCT cell_id) AS n FROM sc s JOIN gent USING (cell_id) GROUP BY 1, 2),
  fs AS (SELECT side, s.target_gene, gene, sum(value / libsize * 1e6) AS s, sum(ln(1 + value / libsize * 1e4)) AS l FROM sc s JOIN gent USING (cell_id) GROUP BY 1, 2, 3),
  fm AS (SELECT side, target_gene, gene, coalesce(s, 0) / fn.n AS m, coalesce(l, 0) / sl.n AS lm FROM sl JOIN fn USING (side, target_gene) CROSS JOIN genes LEFT JOIN fs USING (side, target_gene, gene)),
  fc AS MATERIALIZED (SELECT p.side, p.target_gene, p.gene, log2((p.m + 1) / (c.m + 1)) AS lfc, p.lm - c.lm AS delta
    FROM fm p JOIN fm c ON c.side = p.side AND c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting'),
  preds AS (SELECT k, target_gene, gene, delta FROM arms JOIN fc ON side = p), reals AS (SELECT k, target_gene, gene, delta FROM arms JOIN fc ON side = r),
  {SCORES},
  each AS (SELECT k, metric, value FROM scores WHERE metric IN ('mse', 'pds_cosine')
    UNION ALL SELECT pr.k, 'lfc_nmae', CASE WHEN sum(abs(y.lfc)) > 0 THEN sum(abs(x.lfc - y.lfc)) / sum(abs(y.lfc)) END FROM pr JOIN arms a USING (k)
      JOIN fc x ON x.side = a.p AND x.target_gene = pr.target_gene AND x.gene = pr.gene JOIN fc y ON y.side = a.r AND y.target_gene = pr.target_gene AND y.gene = pr.gene
      WHERE sig_r GROUP BY pr.k, pr.target_gene
    UNION ALL SELECT k, 'sig_jaccard', count(*) FILTER (sig_p AND sig_r) / nullif(count(*) FILTER (sig_p OR sig_r), 0) FROM pr GROUP BY k, target_gene
    UNION ALL SELECT k, 'direction_agreement', count(*) FILTER (sig_r AND sign(z_p) = sign(z_r)) / nullif(count(*) FILTER (sig_r), 0) FROM pr GROUP BY k, target_gene
    UNION ALL SELECT k, 'direction_fidelity', count(*) FILTER (sig_p AND sign(z_p) = sign(z_r)) / nullif(count(*) FILTER (sig_p), 0) FROM pr GROUP BY k, target_gene),
  by_arm AS (SELECT split_part(k, '|', 1) AS arm, split_part(k, '|', 2) AS context, metric, avg(value) AS value FROM each GROUP BY k, metric),
  ubr AS (SELECT context, metric, max(value) FILTER (arm = 'user') AS u, max(value) FILTER (arm = 'base') AS b, avg(value) FILTER (arm LIKE 'split%') AS r FROM by_arm GROUP BY 1, 2),
  raws AS (SELECT *, CASE WHEN abs(r - b) > 1e-9 THEN (u - b) / (r - b) END AS raw FROM ubr),
  scaled AS (SELECT context, metric, u, b, r, CASE WHEN metric = 'mse' THEN greatest(0, least(1, raw)) WHEN metric = 'lfc_nmae' THEN greatest(-6, raw) ELSE raw END AS scaled FROM raws)"""


def members(spark, d):
    return CS.anchored_members(T.count_matrix(spark, d), T.contexts(spark, d), Z, n_splits=SPLITS, seed=11)


@query("score_cell_members", MEMBERS + """
SELECT context, metric, round(u, 6) + 0.0 AS u, round(b, 6) + 0.0 AS b, round(r, 6) + 0.0 AS r, round(scaled, 3) + 0.0 AS scaled FROM scaled""")
def score_cell_members(spark, d):
    return members(spark, d).select("context", "metric", r6("u").alias("u"), r6("b").alias("b"), r6("r").alias("r"), (F.round("scaled", 3) + 0.0).alias("scaled"))


@query("score_cell_overall", MEMBERS + " SELECT round(avg(scaled), 3) + 0.0 AS overall, count(scaled) AS n_members FROM scaled")
def score_cell_overall(spark, d):
    return Q.overall(members(spark, d)).withColumn("overall", F.round("overall", 3) + 0.0)
