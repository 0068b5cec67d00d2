"""Baseline effect models and their predicted cells.

Models are fitted on label moments (see ``pseudobulk.label_moments``) of log-normalised values, so one
pass over the entries fits them all. A model is a table of deltas (target_gene, gene, delta).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.functions.columns import shift_clip_floor
from pertmatrix.matrix import CONTROL, axis_lookup, on_gene_axis
from pertmatrix.operators.sampling import CHUNK, draw_with_replacement, index_pool


def zero_delta(requested: DataFrame, genes: DataFrame) -> DataFrame:
    """Rung 0: every label looks like the controls."""
    return on_gene_axis(requested.select("target_gene").distinct(), genes).select(
        "target_gene", "gene_pos", "gene", F.lit(0.0).alias("delta")
    )


def mean_perturbation_delta(moments: DataFrame, control: str = CONTROL) -> DataFrame:
    """Rung 0b: gene_pos, gene, delta = mean over all perturbed cells minus the control mean (cell-weighted)."""
    is_ctrl = F.col("target_gene") == control
    total, n = F.col("mean") * F.col("n"), F.col("n")
    pert = F.sum(F.when(~is_ctrl, total)) / F.sum(F.when(~is_ctrl, n))
    return moments.groupBy("gene_pos", "gene").agg((pert - F.max(F.when(is_ctrl, F.col("mean")))).alias("delta"))


def same_delta_for(requested: DataFrame, per_gene: DataFrame) -> DataFrame:
    """One per-gene shift for every requested label."""
    grid = on_gene_axis(requested.select("target_gene").distinct(), per_gene.select("gene_pos", "gene"))
    return grid.join(per_gene.select("gene", "delta"), "gene").select("target_gene", "gene_pos", "gene", "delta")


def training_deltas(moments: DataFrame, *, min_cells: int = 10, control: str = CONTROL) -> DataFrame:
    """target_gene, gene, delta, z, m_c, v_c for every training label with enough cells.

    ``moments`` are label moments. z divides by the standard error of the difference of means.
    """
    ctrl = moments.filter(F.col("target_gene") == control).select(
        "gene", F.col("mean").alias("m_c"), F.col("variance").alias("v_c"), F.col("n").alias("n_c")
    )
    pert = moments.filter((F.col("target_gene") != control) & (F.col("n") >= min_cells)).join(ctrl, "gene")
    delta = F.col("mean") - F.col("m_c")
    se = F.sqrt(F.col("v_c") / F.col("n_c") + F.col("variance") / F.col("n"))
    return pert.select(
        "target_gene", "gene_pos", "gene", delta.alias("delta"), (delta / F.greatest(se, F.lit(1e-9))).alias("z"), "m_c", "v_c"
    )


def backbone_features(deltas: DataFrame, *, deg_z: float = 2.0) -> DataFrame:
    """Rung 1 features per gene; labels weigh equally, whatever their cell counts."""
    return deltas.groupBy("gene_pos", "gene").agg(
        F.avg("delta").alias("mean_delta"),
        F.avg((F.abs("z") > deg_z).cast("double")).alias("deg_frequency"),
        F.max("m_c").alias("mean_expression"),
        F.max("v_c").alias("gene_variance"),
        F.avg(F.abs("delta")).alias("effect_size_prior"),
    )


def mean_self_knockdown(deltas: DataFrame) -> DataFrame:
    """One row: knockdown, n_self. 0 when no label is itself a measured gene."""
    own = deltas.filter(F.col("gene") == F.col("target_gene"))
    return own.agg(F.coalesce(F.avg("delta"), F.lit(0.0)).alias("knockdown"), F.count("*").alias("n_self"))


def backbone_delta(
    requested: DataFrame, features: DataFrame, knockdown: DataFrame, *, scale: float = 1.0, apply_knockdown: bool = True
) -> DataFrame:
    """deg_frequency * mean_delta * scale; the label's own gene gets the learnt knockdown instead.

    A label never seen in training gets the generic response, and the knockdown if it is a gene.
    """
    generic = features.select("gene_pos", "gene", (F.lit(float(scale)) * F.col("deg_frequency") * F.col("mean_delta")).alias("delta"))
    full = same_delta_for(requested, generic)
    if not apply_knockdown:
        return full
    own = knockdown.select("knockdown").scalar()
    return full.withColumn("delta", F.when(F.col("gene") == F.col("target_gene"), own).otherwise(F.col("delta")))


def assay_floor(entries: DataFrame, control: str = CONTROL) -> DataFrame:
    """One row: the smallest positive control value (0 when there is none)."""
    positive = entries.filter((F.col("target_gene") == control) & (F.col("value") > 0))
    return positive.agg(F.coalesce(F.min("value"), F.lit(0.0)).alias("floor"))


def predict_cells(
    requests: DataFrame, deltas: DataFrame, entries: DataFrame, cells: DataFrame, genes: DataFrame, *,
    seed: int = 0, include_control: int | None = None, snap_to_floor: bool = True, control: str = CONTROL,
) -> DataFrame:
    """target_gene, cell_no, gene_pos, gene, value: drawn control cells shifted by the label's delta.

    ``requests``: target_gene, n (n <= 0 gives nothing). Control cells stay sparse rows: stored
    values are shifted in place, and of the zeros only genes whose delta reaches the floor can
    become nonzero, so the dense cell x gene grid is never built. gene_pos must run from 0 to G-1.
    Genes a label has no delta for are not shifted. A request for no cells at all, and a requested
    label without any delta, raise an error.
    """
    if requests.filter("n > 0").isEmpty():
        raise ValueError("no cells are requested")
    is_ctrl = F.col("target_gene") == control
    pool_cells = cells.filter(is_ctrl).select("cell_id")
    entry = F.collect_list(F.struct("gene_pos", "value"))
    packed = (
        entries.filter(is_ctrl).join(axis_lookup(genes), "gene").groupBy("cell_id").agg(entry.alias("stored"))
    )
    pool = index_pool(pool_cells, [], seed).join(packed, "cell_id", "left").select(
        "pool_idx", F.coalesce("stored", F.array().cast("array<struct<gene_pos:bigint,value:double>>")).alias("stored")
    )
    n_pool = pool_cells.agg(F.count("*").alias("n")).scalar()

    wanted = requests.select("target_gene", F.col("n").cast("bigint").alias("n"))
    shifts = deltas.select("target_gene", "gene_pos", "delta")
    if include_control:
        extra = wanted.sparkSession.createDataFrame([(control, include_control)], "target_gene string, n bigint")
        wanted = wanted.filter(~is_ctrl).unionByName(extra)
        shifts = shifts.filter(~is_ctrl).unionByName(
            on_gene_axis(extra.select("target_gene"), genes).select("target_gene", "gene_pos", F.lit(0.0).alias("delta"))
        )
    draws = draw_with_replacement(wanted.withColumn("pool_n", n_pool), "n", F.col("pool_n"), ["target_gene"], seed=seed).select(
        "target_gene", "_chunk", F.col("draw_no").alias("cell_no"), "pool_idx"
    )

    floor: Column = assay_floor(entries, control).scalar() if snap_to_floor else F.lit(0.0)
    full = on_gene_axis(shifts.select("target_gene").distinct(), genes).select("target_gene", "gene_pos")
    shifts = full.join(shifts, ["target_gene", "gene_pos"], "left").fillna(0.0, ["delta"])
    vectors = shifts.groupBy("target_gene").agg(F.sort_array(F.collect_list(F.struct("gene_pos", "delta"))).alias("d"))
    last_chunk = F.floor((F.col("n") - 1) / CHUNK).cast("bigint")
    per_chunk = (
        wanted.filter("n > 0").join(vectors, "target_gene", "left").withColumn("floor", floor)
        .withColumn("d", F.coalesce("d", F.raise_error(F.concat(F.lit("no delta for label "), "target_gene")).cast("array<struct<gene_pos:bigint,delta:double>>")))
        .select(
            "target_gene", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)).alias("_chunk"), "floor",
            F.col("d.delta").alias("delta"),
            F.filter("d", lambda x: (x.delta > 0) & (x.delta >= F.col("floor"))).gene_pos.alias("lift"),
        )
    )
    # Spark sees only the few chunks the draws come from: without the hint it would broadcast a row for every predicted cell
    drawn = draws.hint("merge").join(pool, "pool_idx").join(per_chunk, ["target_gene", "_chunk"])
    at = lambda pos: F.col("delta")[pos.cast("int")]
    moved = F.transform(
        "stored", lambda e: F.struct(e.gene_pos.alias("gene_pos"), shift_clip_floor(e.value, at(e.gene_pos), F.col("floor")).alias("value"))
    )
    raised = F.transform(
        F.array_except("lift", F.col("stored.gene_pos")), lambda p: F.struct(p.alias("gene_pos"), at(p).alias("value"))
    )
    return (
        drawn.select("target_gene", "cell_no", F.inline(F.concat(moved, raised)))
        .filter("value > 0")
        .join(axis_lookup(genes), "gene_pos")
        .select("target_gene", "cell_no", "gene_pos", "gene", "value")
    )
