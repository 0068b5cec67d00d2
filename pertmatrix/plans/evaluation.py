"""Composed plans: leave-one-context-out deltas, the model ladder, replicate anchors.

All of them start from one sum per (context, label, gene), written once. Every hold-out, baseline and
fit is then a matter of adding up the right contexts' sums, so the entries are read once however many
contexts are held out and however many models are scored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.functions.hashing import draw_index, seed_hash
from pertmatrix.matrix import CONTROL, on_gene_axis
from pertmatrix.operators import metrics as Q, predictors as R
from pertmatrix.operators.pseudobulk import group_sizes, moment_sums, moments_from_sums
from pertmatrix.session import materialized

KEYS = ["context", "target_gene"]


@dataclass(frozen=True)
class ContextSums:
    """``sums``: context, target_gene, gene, s, ss. ``sizes``: context, target_gene, n_cells."""

    sums: DataFrame
    sizes: DataFrame
    genes: DataFrame


@dataclass(frozen=True)
class Scored:
    """pred and real: context (or another key), target_gene, gene_pos, gene, delta on full grids."""

    pred: DataFrame
    real: DataFrame


def context_sums(entries: DataFrame, cells: DataFrame, genes: DataFrame) -> ContextSums:
    """The one pass over the entries."""
    return ContextSums(
        materialized(moment_sums(entries, KEYS), "context-sums"),
        materialized(group_sizes(cells, KEYS), "context-sizes"),
        materialized(genes, "genes"),
    )


def deltas(moments: DataFrame, control: str = CONTROL) -> DataFrame:
    """context, target_gene, gene_pos, gene, delta against the control of the same context."""
    ctrl = moments.filter(F.col("target_gene") == control).select("context", "gene", F.col("mean").alias("ctrl"))
    pert = moments.filter(F.col("target_gene") != control)
    return pert.join(ctrl, ["context", "gene"]).select(*KEYS, "gene_pos", "gene", (F.col("mean") - F.col("ctrl")).alias("delta"))


def other_contexts(c: ContextSums, contexts: Sequence[str]) -> ContextSums:
    """For each context, the total over all the other contexts."""
    others = F.explode(F.array_except(F.array(*[F.lit(x) for x in contexts]), F.array("context")))

    def moved(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
        away = df.withColumn("_held", others).drop("context").withColumnRenamed("_held", "context")
        return away.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])

    return ContextSums(moved(c.sums, [*KEYS, "gene"], ["s", "ss"]), moved(c.sizes, KEYS, ["n_cells"]), c.genes)


def hold_out_each_context(c: ContextSums, contexts: Sequence[str]) -> Scored:
    """For each context: label deltas inside it (real), and from the cells of all other contexts (pred)."""
    away = other_contexts(c, contexts)
    real = deltas(moments_from_sums(c.sums, c.sizes, c.genes, KEYS))
    return Scored(deltas(moments_from_sums(away.sums, away.sizes, c.genes, KEYS)), real)


def generic_response(c: ContextSums, real: DataFrame, control: str = CONTROL) -> Scored:
    """The 0-end of the scale: every label of a held-out context gets that context's mean effect."""
    is_ctrl = F.col("target_gene") == control

    def both(value: str, name: str) -> list:
        return [F.sum(F.when(is_ctrl, F.col(value))).alias(f"{name}_c"), F.sum(F.when(~is_ctrl, F.col(value))).alias(f"{name}_p")]

    sizes = c.sizes.groupBy("context").agg(*both("n_cells", "n"))
    sums = c.sums.groupBy("context", "gene").agg(*both("s", "s"))
    mean = (
        on_gene_axis(sizes, c.genes).join(sums, ["context", "gene"], "left").fillna(0.0, ["s_c", "s_p"])
        .select("context", "gene", (F.col("s_p") / F.col("n_p") - F.col("s_c") / F.col("n_c")).alias("delta"))
    )
    return Scored(real.drop("delta").join(mean, ["context", "gene"]).select(*KEYS, "gene_pos", "gene", "delta"), real)


def with_halves(cells: DataFrame, n_splits: int = 5) -> DataFrame:
    """``cells`` with ``_halves``: bit s says in which half the cell is in split s."""
    bits = [F.shiftleft(draw_index(seed_hash(f"split{s}", "cell_id"), F.lit(2)), s) for s in range(n_splits)]
    return cells.withColumn("_halves", reduce(Column.__add__, bits))


def replicate_halves(entries: DataFrame, cells: DataFrame, genes: DataFrame, n_splits: int = 5) -> Scored:
    """Deltas of two random halves of every label's cells, for several seeds: the split is in ``context``.

    Both ``entries`` and ``cells`` come from cells of ``with_halves``, so halves are drawn once a cell and not for
    each entry. One pass sums both halves of all seeds side by side; no cell is repeated.
    """
    def half(split: int):
        return F.shiftright("_halves", split).bitwiseAND(F.lit(1))

    def halves(agg, name: str) -> list:
        return [agg(half(s), h).alias(f"{name}{s}_{h}") for s in range(n_splits) for h in (0, 1)]

    def rows(wide: DataFrame, keys: Sequence[str], name: str, split: int) -> DataFrame:
        cells_of = F.array(*[
            F.struct(F.lit(f"split{s}").alias("context"), F.col(f"{name}{s}_{split}").alias(name)) for s in range(n_splits)
        ])
        return wide.select(*keys, F.inline(cells_of))

    sums = materialized(
        entries.groupBy("target_gene", "gene").agg(*halves(lambda c, h: F.sum(F.when(c == h, F.col("value"))), "s")), "half-sums"
    )
    sizes = materialized(cells.groupBy("target_gene").agg(*halves(lambda c, h: F.count_if(c == h), "n_cells")), "half-sizes")

    def side(h: int) -> DataFrame:
        s = rows(sums, ["target_gene", "gene"], "s", h).withColumn("ss", F.lit(0.0))
        return deltas(moments_from_sums(s, rows(sizes, ["target_gene"], "n_cells", h).filter("n_cells > 0"), genes, KEYS))

    return Scored(side(0), side(1))


def delta_scores(pair: Scored, by: Sequence[str] = ("context",)) -> DataFrame:
    """by..., target_gene, metric, value for the metrics that need no cells."""
    keys = [*by, "target_gene"]
    errors = Q.error_metrics(Q.paired(pair.pred, pair.real, by), by).unpivot(keys, ["mae", "mse", "pearson_delta"], "metric", "value")
    ranks = Q.discrimination(pair.pred, pair.real, ["l1", "cosine"], by)
    return errors.unionByName(ranks.select(*keys, F.concat(F.lit("pds_"), "kind").alias("metric"), F.col("score").alias("value")))


def score_arms(arms: Mapping[str, Scored]) -> DataFrame:
    """arm, context, metric, value: mean scores of several predictions, scored together in one pass."""
    def all_of(side: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [getattr(pair, side).withColumn("arm", F.lit(name)) for name, pair in arms.items()])

    by = ["arm", "context"]
    return materialized(Q.metric_means(delta_scores(Scored(all_of("pred"), all_of("real")), by), by), "arm-scores")


def ladder(c: ContextSums, held_out: str, contexts: Sequence[str]) -> Scored:
    """Rungs 0, 0b and 1 fitted on all other contexts and set against the held-out one; the model is in ``context``."""
    held = F.col("context") == held_out
    away = other_contexts(c, contexts)
    train = moments_from_sums(away.sums.filter(held), away.sizes.filter(held), c.genes, KEYS)
    real = deltas(moments_from_sums(c.sums.filter(held), c.sizes.filter(held), c.genes, KEYS))
    requested = real.select("target_gene").distinct()
    fitted = R.training_deltas(train)
    preds = {
        "rung0": R.zero_delta(requested, c.genes),
        "rung0b": R.same_delta_for(requested, R.mean_perturbation_delta(train)),
        "rung1": R.backbone_delta(requested, R.backbone_features(fitted), R.mean_self_knockdown(fitted)),
    }
    pred = reduce(DataFrame.unionByName, [df.withColumn("context", F.lit(name)) for name, df in preds.items()])
    names = F.explode(F.array(*[F.lit(n) for n in preds]))
    return Scored(pred, real.select("target_gene", "gene_pos", "gene", "delta").withColumn("context", names))
