"""Queries: a ladder of models, one of them written here, scored on predicted cells; prior sources against what they declare."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pertmatrix.operators import axis, edges as E, metrics as Q, models as M, predictors as R, priors as PS
from pertmatrix.plans import cell_scores as CS
from pertmatrix.plans.q_cell_scores import TESTS
from pertmatrix.plans.q_cells import HELD_OUT
from pertmatrix.plans.q_graph import BASE
from pertmatrix.plans.q_metrics import LADDER, SCORES, Z
from pertmatrix.plans.registry import MATRIX_LOG, query, r6
from pertmatrix.session import materialized
from pertmatrix.sources import testdata as T

# -- models ----------------------------------------------------------------------------------


class SeenLabels(M.Predictor):
    """A rung of a user's own: a label seen in training keeps its effect, shrunk by its z; others get the mean response."""

    name = "seen"

    def fit(self, moments):
        return R.training_deltas(moments), R.mean_perturbation_delta(moments)

    def deltas(self, fitted, requested, genes):
        seen, mean = fitted
        kept = F.when(F.abs("z") > 1, F.col("delta") * (1 - 1 / (F.col("z") * F.col("z")))).otherwise(0.0)
        labels = seen.select("target_gene").distinct().withColumn("_seen", F.lit(True))
        own = seen.select("target_gene", "gene", kept.alias("own"))
        grid = R.same_delta_for(requested, mean).join(labels, "target_gene", "left").join(own, ["target_gene", "gene"], "left")
        return grid.withColumn("delta", F.when(F.col("_seen"), F.col("own")).otherwise(F.col("delta"))).select(*M.COLUMNS)


MODELS = (*M.RUNGS, SeenLabels())

HELD_TESTS = f"""
  held AS (SELECT cell_id, target_gene FROM cells WHERE context = '{HELD_OUT}'),
  req AS (SELECT target_gene, count(*) AS n FROM held WHERE target_gene <> 'non-targeting' GROUP BY 1),
  own AS (SELECT target_gene, gene, CASE WHEN abs(z) > 1 THEN delta * (1 - 1 / (z * z)) ELSE 0 END AS delta FROM td),
  md AS (SELECT 'rung0' AS k, target_gene, gene, 0.0 AS delta FROM req CROSS JOIN genes
    UNION ALL SELECT 'rung0b', target_gene, gene, delta FROM req CROSS JOIN ob
    UNION ALL SELECT 'rung1', target_gene, gene, CASE WHEN gene = target_gene THEN coalesce((SELECT avg(delta) FROM td WHERE gene = target_gene), 0) ELSE ft.delta END FROM req CROSS JOIN ft
    UNION ALL SELECT 'seen', target_gene, gene, CASE WHEN target_gene IN (SELECT target_gene FROM td) THEN own.delta ELSE ob.delta END
      FROM req CROSS JOIN ob LEFT JOIN own USING (target_gene, gene)),
  pool AS MATERIALIZED (SELECT cell_id, row_number() OVER (ORDER BY md5('pool0:' || cell_id), cell_id) - 1 AS pool_idx FROM cells WHERE target_gene = 'non-targeting' AND context <> '{HELD_OUT}'),
  lowest AS (SELECT min(value) AS f FROM logged JOIN pool USING (cell_id) WHERE value > 0),
  draws AS MATERIALIZED (SELECT k, target_gene, no, CAST('0x' || substr(md5('draw0:' || k || '|' || target_gene || ':' || no), 1, 15) AS BIGINT) % (SELECT count(*) FROM pool) AS pool_idx
    FROM (SELECT k, target_gene, unnest(range(n)) AS no FROM req CROSS JOIN (SELECT DISTINCT k FROM md) m) w),
  pred AS (SELECT k, d.target_gene, no, gene, greatest(coalesce(value, 0) + delta, 0) AS v
    FROM draws d JOIN pool USING (pool_idx) JOIN md USING (k, target_gene) LEFT JOIN logged l USING (cell_id, gene)),
  sides AS (SELECT DISTINCT k FROM md UNION ALL SELECT 'real'),
  sc AS MATERIALIZED (SELECT k AS side, target_gene, k || ':' || cell_id AS cell_id FROM held CROSS JOIN sides WHERE k = 'real' OR target_gene = 'non-targeting'
    UNION ALL SELECT k, target_gene, k || ':' || target_gene || ':' || no FROM draws),
  gent AS MATERIALIZED (SELECT k || ':' || cell_id AS cell_id, gene, value FROM held JOIN logged USING (cell_id) CROSS JOIN sides WHERE k = 'real' OR held.target_gene = 'non-targeting'
    UNION ALL SELECT k || ':' || target_gene || ':' || no, gene, v FROM pred, lowest WHERE v >= f AND v > 0),
  {TESTS},
  pr AS MATERIALIZED (SELECT p.side AS k, target_gene, gene, p.z AS z_p, q.z AS z_r, abs(p.z) > {Z} AS sig_p, abs(q.z) > {Z} AS sig_r
    FROM sz p JOIN sz q USING (target_gene, gene) WHERE p.side <> 'real' AND q.side = 'real'),
  fs AS (SELECT side, s.target_gene, gene, sum((exp(value) - 1) * 100) AS s, sum(value) AS l FROM sc s JOIN gent USING (cell_id) GROUP BY 1, 2, 3),
  fm AS (SELECT side, target_gene, gene, coalesce(s, 0) / n AS m, coalesce(l, 0) / n AS lm FROM sl CROSS JOIN genes LEFT JOIN fs USING (side, target_gene, gene)),
  fc AS MATERIALIZED (SELECT p.side, p.target_gene, p.gene, log2((p.m + 1) / (c.m + 1)) AS lfc, p.lm - c.lm AS delta
    FROM fm p JOIN fm c ON c.side = p.side AND c.gene = p.gene AND c.target_gene = 'non-targeting' WHERE p.target_gene <> 'non-targeting'),
  preds AS (SELECT side AS k, target_gene, gene, delta FROM fc WHERE side <> 'real'),
  reals AS (SELECT k, target_gene, gene, delta FROM fc CROSS JOIN (SELECT DISTINCT k FROM md) m WHERE side = 'real'),
  {SCORES},
  each AS (SELECT k, target_gene, metric, value FROM scores WHERE metric IN ('mse', 'pds_cosine')
    UNION ALL SELECT pr.k, target_gene, 'lfc_nmae', CASE WHEN sum(abs(y.lfc)) > 0 THEN sum(abs(x.lfc - y.lfc)) / sum(abs(y.lfc)) END
      FROM pr JOIN fc x USING (target_gene, gene) JOIN fc y USING (target_gene, gene) WHERE x.side = pr.k AND y.side = 'real' AND sig_r GROUP BY 1, 2
    UNION ALL SELECT k, target_gene, 'sig_jaccard', count(*) FILTER (sig_p AND sig_r) / nullif(count(*) FILTER (sig_p OR sig_r), 0) FROM pr GROUP BY 1, 2
    UNION ALL SELECT k, target_gene, 'direction_agreement', count(*) FILTER (sig_r AND sign(z_p) = sign(z_r)) / nullif(count(*) FILTER (sig_r), 0) FROM pr GROUP BY 1, 2
    UNION ALL SELECT k, target_gene, 'direction_fidelity', count(*) FILTER (sig_p AND sign(z_p) = sign(z_r)) / nullif(count(*) FILTER (sig_p), 0) FROM pr GROUP BY 1, 2)"""
CELL_LADDER = f"WITH {MATRIX_LOG}, {LADDER.split('  real1 AS')[0].rstrip().rstrip(',')}, {HELD_TESTS}"


def cell_ladder(spark, d) -> DataFrame:
    return materialized(CS.ladder_scores(T.count_matrix(spark, d), MODELS, HELD_OUT, Z), "cell-ladder")


@query("model_ladder_cells", f"""{CELL_LADDER},
  av AS (SELECT k, metric, avg(value) AS value FROM each GROUP BY 1, 2),
  rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY round(CASE WHEN metric IN ('mse', 'lfc_nmae') THEN value ELSE -value END, 9) ASC NULLS LAST) AS rank FROM av)
SELECT k AS model, {", ".join(f"round(max(value) FILTER (metric = '{x}'), 6) + 0.0 AS {x}" for x in CS.MEMBERS)}, round(avg(rank), 6) AS avg_rank FROM rk GROUP BY 1""")
def model_ladder_cells(spark, d):
    """Three given rungs and one of the user's, fitted on four contexts, their predicted cells scored in the fifth."""
    report = Q.ladder_report(Q.metric_means(cell_ladder(spark, d), ["model"]), CS.MEMBERS)
    return report.select("model", *[r6(c).alias(c) for c in [*CS.MEMBERS, "avg_rank"]])


@query("guardrail_cells", f"""{CELL_LADDER},
  split AS (SELECT k, metric, CAST(substr(target_gene, 7) AS INTEGER) % 2 = 0 AS pub, avg(value) AS value FROM each GROUP BY 1, 2, 3),
  gain AS (SELECT s.k, metric, s.pub, round((s.value - b.value) * CASE WHEN metric IN ('mse', 'lfc_nmae') THEN -1 ELSE 1 END, 9) AS g
           FROM split s JOIN split b USING (metric, pub) WHERE b.k = 'rung0' AND s.k <> 'rung0'),
  gains AS (SELECT k, metric, max(g) FILTER (pub) AS gp, max(g) FILTER (NOT pub) AS gq FROM gain GROUP BY 1, 2)
SELECT k AS model, metric, round(gp, 6) + 0.0 AS gain_public, round(gq, 6) + 0.0 AS gain_private, gp > 0 AND gq <= 0 AS blocked FROM gains""")
def guardrail_cells(spark, d):
    """Gains over rung 0 on even (public) and odd (private) labels, of the scores of predicted cells."""
    scores = cell_ladder(spark, d)
    public = F.substring("target_gene", 7, 10).cast("int") % 2 == 0
    means = [Q.metric_means(scores.filter(part), ["model"]) for part in (public, ~public)]
    out = Q.private_gain_guard(*means, baseline="rung0").withColumns({c: F.round(c, 9) for c in ("gain_public", "gain_private")})
    blocked = (F.col("gain_public") > 0) & (F.col("gain_private") <= 0)
    return out.select("model", "metric", r6("gain_public").alias("gain_public"), r6("gain_private").alias("gain_private"), blocked.alias("blocked"))


# -- prior sources ---------------------------------------------------------------------------


class TableEdges(PS.PriorSource):
    """Edges of the given tables that pass a condition, with their score, and with ``also`` a second attribute."""

    def __init__(self, declared: PS.Declared, edges: DataFrame, condition: str, also: str | None = None):
        self.declared, self.edges, self.condition, self.also = declared, edges, condition, also

    def build(self, index):
        score = F.col("score").cast("double")
        attr = F.array(score) if self.also is None else F.expr(f"if({self.also}, array(cast(score AS double), 1D), array(cast(score AS double)))")
        return E.align_edges(self.edges.filter(self.condition), index).select("src_pos", "dst_pos", attr.alias("attr"))


class SupplierFeatures(PS.PriorSource):
    """Number and balance of a gene's suppliers; ``fill`` gives genes without any a row of zeros."""

    def __init__(self, declared: PS.Declared, suppliers: DataFrame, fill: bool = True):
        self.declared, self.suppliers, self.fill = declared, suppliers, fill

    def build(self, index):
        named = self.suppliers.select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 20).cast("string")).alias("gene"), "s_acctbal")
        sums = named.groupBy("gene").agg(F.array(F.count("*").cast("double"), F.sum("s_acctbal")).alias("features"))
        rows = axis.to_positions(sums, index, "gene").select("gene_pos", "features")
        return E.concat_features(index, [(rows, 2)]) if self.fill else rows


def prior_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    return materialized(T.edges(spark, d), "edges"), T.table(spark, d, "supplier"), axis.gene_index(T.genes(spark, d), "gene")


SUPPLIED = "supplied AS (SELECT 'Brand#' || (s_suppkey % 20) AS gene, count(*) AS n, sum(s_acctbal) AS bal FROM supplier GROUP BY 1)"


@query("priors_check", f"""{BASE}, {SUPPLIED}
SELECT * FROM (
  SELECT 'posttx:binding:pairs' AS source, 'attr: not 2 values' AS rule, count(*) AS n FROM aligned WHERE score >= 2 AND region <> 'R'
  UNION ALL SELECT 'posttx:binding:table', 'built node_feature, declared edge', count(*) FROM genes
  UNION ALL SELECT 'trans:target:profile', 'built edge, declared node_feature', count(*) FROM aligned
  UNION ALL SELECT 'cell:supply:partial', 'gene without exactly one row', count(*) FROM genes ANTI JOIN supplied USING (gene)) v WHERE n > 0""")
def priors_check(spark, d):
    """Sources that keep their declaration, and ones of another kind, with a missing attribute and with missing genes."""
    edges, suppliers, index = prior_inputs(spark, d)
    return PS.check([
        TableEdges(PS.Declared("trans", "tf_target", "regulators", PS.EDGE, 1), edges, "confidence <= 'C'"),
        TableEdges(PS.Declared("posttx", "binding", "pairs", PS.EDGE, 2), edges, "score >= 2", "region = 'R'"),
        SupplierFeatures(PS.Declared("posttx", "binding", "table", PS.EDGE, 1), suppliers),
        TableEdges(PS.Declared("trans", "target", "profile", PS.FEATURE, 1), edges, "true"),
        SupplierFeatures(PS.Declared("cell", "supply", "counts", PS.FEATURE, 2), suppliers),
        SupplierFeatures(PS.Declared("cell", "supply", "partial", PS.FEATURE, 2), suppliers, fill=False),
        TableEdges(PS.Declared("posttx", "binding", "table", PS.EDGE, 9, enabled=False), edges, "true"),
    ], index)


@query("priors_graph", f"""{BASE}, {SUPPLIED}
SELECT 'trans:tf_target:regulators' AS part, src_pos, dst_pos, 1 AS width, CAST(score AS DOUBLE) AS first, CAST(NULL AS DOUBLE) AS last FROM aligned WHERE confidence <= 'C'
UNION ALL SELECT 'posttx:binding:pairs', src_pos, dst_pos, 2, score, 1 FROM aligned WHERE region = 'R'
UNION ALL SELECT 'features', gene_pos, NULL, 2, coalesce(n, 0), round(coalesce(bal, 0), 6) + 0.0 FROM genes LEFT JOIN supplied USING (gene)""")
def priors_graph(spark, d):
    """Two edge sources with one and two attributes and a feature source as one graph."""
    edges, suppliers, index = prior_inputs(spark, d)
    graph = PS.assemble([
        TableEdges(PS.Declared("trans", "tf_target", "regulators", PS.EDGE, 1), edges, "confidence <= 'C'"),
        TableEdges(PS.Declared("posttx", "binding", "pairs", PS.EDGE, 2), edges, "region = 'R'", "true"),
        SupplierFeatures(PS.Declared("cell", "supply", "counts", PS.FEATURE, 2), suppliers),
    ], index)
    values = lambda c: [F.size(c).alias("width"), F.get(c, F.lit(0)).alias("first"), F.get(c, F.lit(1)).alias("last")]
    ends = graph.edges.select(F.col("edge_type").alias("part"), "src_pos", "dst_pos", *values("attr"))
    rows = graph.features.select(F.lit("features").alias("part"), F.col("gene_pos").alias("src_pos"), F.lit(None).cast("bigint").alias("dst_pos"), *values("features"))
    return ends.unionByName(rows).withColumn("last", r6("last"))
