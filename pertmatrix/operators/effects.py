"""Effect estimates: log2 fold changes with variance, shrinkage, pooling over sources, transfer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pertmatrix.functions.columns import log2_fold_change, log2_fold_change_var, shrink_positive_part
from pertmatrix.matrix import CONTROL, on_gene_axis
from pertmatrix.operators.pseudobulk import PseudobulkSums, mean_var_cpm

# Fixed value: log2 fold change set for the knocked-down target itself.
TARGET_SELF_LOG2FC = -2.32


def log2fc_with_var(pb: PseudobulkSums, genes: DataFrame, *, control: str = CONTROL, pseudocount: float = 1.0) -> DataFrame:
    """by..., gene, log2fc, var against the control of the same source, for every non-control label."""
    per_source = [c for c in pb.by if c != "target_gene"]
    n = F.greatest(F.col("n_cells"), F.lit(1))
    grid = mean_var_cpm(pb, genes).withColumn("n", n)
    ctrl = grid.filter(F.col("target_gene") == control).select(
        *per_source, "gene", F.col("mean_cpm").alias("m_c"), F.col("var_cpm").alias("v_c"), F.col("n").alias("n_c")
    )
    pert = grid.filter(F.col("target_gene") != control)
    both = pert.join(ctrl, [*per_source, "gene"])
    c = F.col
    return both.select(
        *pb.by, "gene",
        log2_fold_change(c("mean_cpm"), c("m_c"), pseudocount).alias("log2fc"),
        log2_fold_change_var(c("mean_cpm"), c("var_cpm"), c("n"), c("m_c"), c("v_c"), c("n_c"), pseudocount).alias("var"),
    )


def shrink(effects: DataFrame) -> DataFrame:
    """Effects with log2fc shrunk; ``var`` stays the unshrunk variance."""
    return effects.withColumn("log2fc", shrink_positive_part(F.col("log2fc"), F.col("var")))


def remap_to_axis(values: DataFrame, source_axis: DataFrame, target_axis: DataFrame, fill: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Values by source position onto the target axis by gene name.

    ``values``: keys..., gene_pos, value. A gene listed twice at the source takes its last position;
    genes the source lacks get ``fill``; genes the target lacks drop.
    """
    last = source_axis.groupBy("gene").agg(F.max("gene_pos").alias("gene_pos"))
    placed = values.join(last, "gene_pos").select(*keys, "gene", "value")
    if not keys:
        out = target_axis.select("gene_pos", "gene").join(placed, "gene", "left")
    else:
        rows = values.select(*keys).distinct()
        out = on_gene_axis(rows, target_axis).join(placed, [*keys, "gene"], "left")
    return out.select(*keys, "gene_pos", "gene", F.coalesce("value", F.lit(float(fill))).alias("value"))


def mean_shift(effects: DataFrame, target_axis: DataFrame) -> DataFrame:
    """gene, shift: mean log2fc over a source's labels; genes without a value get 0."""
    means = effects.groupBy("gene").agg(F.avg("log2fc").alias("shift"))
    return target_axis.select("gene").join(means, "gene", "left").fillna(0.0, ["shift"])


def pool_inverse_variance(effects: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., target_gene, gene, pooled: weights 1 / max(var, 1e-6) over all sources."""
    w = 1.0 / F.greatest(F.col("var"), F.lit(1e-6))
    return effects.groupBy(*by, "target_gene", "gene").agg((F.sum(F.col("log2fc") * w) / F.sum(w)).alias("pooled"))


def pooled_for_targets(
    targets: DataFrame, effects: DataFrame, genes: DataFrame, *, shrinkage: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """by..., target_gene, gene, covered, pooled for every requested target.

    A target some source perturbed has 0 at genes no source measured; one that no source
    perturbed has NULL everywhere. Weights use the variance before shrinkage.
    """
    keys = [*by, "target_gene"]
    covered = effects.select(*keys).distinct().withColumn("covered", F.lit(True))
    pooled = pool_inverse_variance(shrink(effects) if shrinkage else effects, by)
    rows = targets.select(*keys).distinct().join(covered, keys, "left")
    grid = on_gene_axis(rows, genes).join(pooled, [*keys, "gene"], "left")
    value = F.when(F.col("covered"), F.coalesce("pooled", F.lit(0.0)))
    return grid.select(
        *keys, "gene_pos", "gene", F.coalesce("covered", F.lit(False)).alias("covered"), value.alias("pooled")
    )


def transfer_delta(
    targets: DataFrame, effects: DataFrame, genes: DataFrame, *, fallback: DataFrame | None = None,
    shrinkage: bool = True, alpha: float = 1.0, self_log2fc: float = TARGET_SELF_LOG2FC, by: Sequence[str] = (),
) -> DataFrame:
    """by..., target_gene, gene, covered, shift: pooled effect, or the fallback where no source covers a target.

    Order: shrink, pool, scale by alpha, then the target's own gene is set, unscaled. Without a
    fallback an uncovered target has NULL shifts (no shift at all, its own gene included).
    """
    pooled = pooled_for_targets(targets, effects, genes, shrinkage=shrinkage, by=by)
    raw = F.col("pooled")
    if fallback is not None:
        pooled = pooled.join(fallback.select("gene", F.col("shift").alias("generic")), "gene", "left")
        raw = F.coalesce("pooled", "generic")
    own = (F.col("gene") == F.col("target_gene")) & raw.isNotNull()
    shift = F.when(own, F.lit(self_log2fc)).otherwise(raw * F.lit(float(alpha)))
    return pooled.select(*by, "target_gene", "gene_pos", "gene", "covered", shift.alias("shift"))
