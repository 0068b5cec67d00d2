"""Per-label sums, profiles and moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.functions.columns import pop_var
from pertmatrix.functions.hashing import draw_index, seed_hash
from pertmatrix.matrix import CONTROL, CountMatrix, on_gene_axis
from pertmatrix.operators.cells import filter_matrix, labelled
from pertmatrix.operators.ranking import running_total
from pertmatrix.operators.sampling import explode_range, index_pool
from pertmatrix.session import materialized

AGGREGATES = ("sum", "mean", "median")
SUM_COLUMNS = ("count_sum", "cpm_sum", "cpm_sq_sum")


@dataclass(frozen=True)
class PseudobulkSums:
    """``gene``: by..., gene, count_sum, cpm_sum, cpm_sq_sum. ``label``: by..., n_cells, libsize_sum.

    Both are small (labels x genes). Effects read them several times, so they should be written
    once (``label_sums(save=True)`` or :func:`pertmatrix.sources.sinks.write_pseudobulk`).
    """

    gene: DataFrame
    label: DataFrame
    by: tuple[str, ...] = ("target_gene",)


def sum_entries(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (by, gene): counts, CPM and squared CPM, summed, and n_leads, the cells that lead here.

    Partial sums run before the shuffle, so a hot label costs one row per gene and map task.
    """
    cpm = F.col("value") / F.col("libsize") * 1e6
    return entries.groupBy(*by, "gene").agg(
        F.sum("value").alias("count_sum"), F.sum(cpm).alias("cpm_sum"), F.sum(cpm * cpm).alias("cpm_sq_sum"),
        F.count_if("leads").alias("n_leads"),
    )


def label_sums(
    matrix: CountMatrix, *, keep: DataFrame | None = None, skip: DataFrame | None = None,
    by: Sequence[str] = ("target_gene",), save: bool = False,
) -> PseudobulkSums:
    """The core pass. Empty cells count neither in the sums nor in n_cells; a label whose cells are
    all empty stays with n_cells 0. ``save`` writes the sums to scratch space, for plans that use
    them more than once."""
    kept = filter_matrix(matrix, keep, skip)
    return entry_sums(labelled(kept), kept.cells, by, save)


def entry_sums(entries: DataFrame, cells: DataFrame, by: Sequence[str], save: bool = False) -> PseudobulkSums:
    """The sums of labelled entries whose cells are ``cells``."""
    gene = sum_entries(entries, by)
    if save:
        gene = materialized(gene, "pb-gene")
    totals = gene.groupBy(*by).agg(F.sum("n_leads").alias("n_cells"), F.sum("count_sum").alias("libsize_sum"))
    label = cells.select(*by).distinct().join(totals, list(by), "left").fillna({"n_cells": 0, "libsize_sum": 0.0})
    if save:
        label = materialized(label, "pb-label")
    return PseudobulkSums(gene.drop("n_leads"), label, tuple(by))


def merge(a: PseudobulkSums, b: PseudobulkSums) -> PseudobulkSums:
    """Add two passes over the same gene axis; labels are united."""
    by = a.by
    gene = a.gene.unionByName(b.gene).groupBy(*by, "gene").agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])
    label = a.label.unionByName(b.label).groupBy(*by).agg(
        F.sum("n_cells").alias("n_cells"), F.sum("libsize_sum").alias("libsize_sum")
    )
    return PseudobulkSums(gene, label, by)


def control_once(cells: DataFrame, source_ord: str = "source_ord", control: str = CONTROL) -> DataFrame:
    """Drop the control cells that later sources repeat."""
    return cells.filter((F.col("target_gene") != control) | (F.col(source_ord) == 0))


def mean_var_cpm(pb: PseudobulkSums, genes: DataFrame) -> DataFrame:
    """by..., gene, n_cells, mean_cpm, var_cpm on the full label x gene grid."""
    n = F.greatest(F.col("n_cells"), F.lit(1))
    grid = on_gene_axis(pb.label.select(*pb.by, "n_cells"), genes)
    full = grid.join(pb.gene, [*pb.by, "gene"], "left").fillna(0.0, list(SUM_COLUMNS))
    return full.select(
        *pb.by, "gene_pos", "gene", "n_cells",
        (F.col("cpm_sum") / n).alias("mean_cpm"),
        pop_var(F.col("cpm_sq_sum"), F.col("cpm_sum"), n).alias("var_cpm"),
    )


def group_sizes(cells: DataFrame, by: Sequence[str], min_cells: int = 0) -> DataFrame:
    """Groups with at least min_cells cells. Empty cells count."""
    return cells.groupBy(*by).agg(F.count("*").alias("n_cells")).filter(F.col("n_cells") >= min_cells)


def value_histogram(entries: DataFrame, sizes: DataFrame, genes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., gene, value, freq with the implicit zeros as one row per (group, gene).

    The counted values are written once: everything after them works on the histogram. So are the sizes, whose true
    size lets Spark broadcast them instead of shuffling the histogram by a label that may hold a third of it.
    """
    sizes = materialized(sizes.select(*by, "n_cells"), "histogram-sizes")
    hist = materialized(entries.groupBy(*by, "gene", "value").agg(F.count("*").alias("freq")), "histogram")
    stored = hist.groupBy(*by, "gene").agg(F.sum("freq").alias("stored"))
    zeros = (
        on_gene_axis(sizes, genes)
        .join(stored, [*by, "gene"], "left")
        .select(*by, "gene", F.lit(0.0).alias("value"), (F.col("n_cells") - F.coalesce("stored", F.lit(0))).alias("freq"))
        .filter("freq > 0")
    )
    return hist.join(sizes.select(*by), list(by), "left_semi").unionByName(zeros)


def histogram_quantile(hist: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Linear-interpolation quantile of a (keys..., value, freq) histogram, exact for any group size."""
    n = hist.groupBy(*keys).agg(F.sum("freq").alias("n"))
    ranked = running_total(hist, keys, "value", "freq").join(n, list(keys))
    position = F.lit(q) * (F.col("n") - 1)
    lo, hi = F.floor(position), F.ceil(position)

    def at(rank: Column) -> Column:
        inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("freq"))
        return F.max(F.when(inside, F.col("value")))

    picked = ranked.groupBy(*keys).agg(at(lo).alias("lo"), at(hi).alias("hi"), F.max(position - lo).alias("part"))
    return picked.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("value"))


def group_profiles(
    entries: DataFrame, cells: DataFrame, genes: DataFrame, by: Sequence[str], how: str = "sum", min_cells: int = 25
) -> DataFrame:
    """by..., gene, value, n_cells, replicate: one profile per group over all its cells, zeros included."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}; expected one of {AGGREGATES}")
    missing = [c for c in by if c not in cells.columns]
    if missing:
        raise KeyError(f"grouping columns not in cells: {missing}")
    sizes = group_sizes(cells, by, min_cells)
    if how == "median":
        values = histogram_quantile(value_histogram(entries, sizes, genes, by), [*by, "gene"], 0.5)
    else:
        values = entries.groupBy(*by, "gene").agg(F.sum("value").alias("value"))
    # small groups drop here, after the sums: no entry is shuffled only to be filtered
    full = on_gene_axis(sizes, genes).join(values, [*by, "gene"], "left").fillna(0.0, ["value"])
    if how == "mean":
        full = full.withColumn("value", F.col("value") / F.col("n_cells"))
    return full.select(*by, "gene", "value", "n_cells", F.lit(0).cast("bigint").alias("replicate"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or an error when it has no row. Runs a one-row job."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def bootstrap_draws(cells: DataFrame, by: Sequence[str], replicates: int, *, min_cells: int = 25, seed: int = 0) -> DataFrame:
    """by..., replicate, cell_id, times: the draws of :func:`draw_vectors` as one row for each replicate that draws a cell."""
    vectors = draw_vectors(cells, by, replicates, min_cells=min_cells, seed=seed)
    each = vectors.select(*by, "cell_id", F.posexplode("times").alias("replicate", "times"))
    return each.filter("times > 0").select(*by, F.col("replicate").cast("bigint"), "cell_id", F.col("times").cast("bigint"))


def draw_vectors(cells: DataFrame, by: Sequence[str], replicates: int, *, min_cells: int = 25, seed: int = 0) -> DataFrame:
    """by..., cell_id, times: how often each replicate draws the cell, of n draws with replacement per group and replicate.

    ``times`` is one array with a count for each replicate; cells that none draws are left out.
    """
    numbered = explode_range(group_sizes(cells, by, min_cells).withColumn("n", F.col("n_cells")), "n_cells", "draw_no")
    each = numbered.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<bigint>")))
    drawn = each.withColumn(
        "pool_idx", draw_index(seed_hash(f"draw{seed}", *by, "replicate", "draw_no"), F.col("n"))
    )
    counts = drawn.groupBy(*by, "pool_idx", "replicate").agg(F.count("*").cast("int").alias("k"))
    pairs = counts.groupBy(*by, "pool_idx").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "k"))).alias("_m"))
    replicate = F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<bigint>")
    times = pairs.withColumn("times", F.transform(replicate, lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0)))).drop("_m")
    pool = index_pool(cells.select(*by, "cell_id"), by, seed)
    # as many rows as cells, of which Spark sees only the few chunks they come from: neither side may be broadcast
    return times.hint("merge").join(pool, [*by, "pool_idx"]).drop("pool_idx")


#: Replicates that are summed in one pass over the entries: so many columns a row of partial sums has.
REPLICATES_AT_ONCE = 64


def bootstrap_profiles(
    entries: DataFrame, cells: DataFrame, genes: DataFrame, by: Sequence[str], replicates: int, *,
    how: str = "sum", min_cells: int = 25, seed: int = 0,
) -> DataFrame:
    """Pseudo-replicate profiles: by..., replicate, gene, value, n_cells. ``how`` is sum or mean.

    A cell meets one vector of its draw counts, and a (group, gene) has one row of partial sums with a column for each
    replicate: replicates multiply neither the entries nor the rows that are shuffled.
    """
    if how not in ("sum", "mean"):
        raise ValueError("bootstrap profiles are sums or means")
    draws = draw_vectors(cells, by, replicates, min_cells=min_cells, seed=seed)
    if replicates > REPLICATES_AT_ONCE:
        draws = materialized(draws, "draws")
    met = entries.select("cell_id", "gene", "value").join(draws.hint("merge"), "cell_id")
    parts = []
    for first in range(0, replicates, REPLICATES_AT_ONCE):
        block = range(first, min(first + REPLICATES_AT_ONCE, replicates))
        wide = met.groupBy(*by, "gene").agg(*[F.sum(F.col("value") * F.get("times", F.lit(r))).alias(f"_r{r}") for r in block])
        long = F.array(*[F.struct(F.lit(r).cast("bigint").alias("replicate"), F.col(f"_r{r}").alias("value")) for r in block])
        parts.append(wide.select(*by, "gene", F.inline(long)))
    summed = reduce(DataFrame.unionByName, parts)
    rows = group_sizes(cells, by, min_cells).withColumn(
        "replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<bigint>"))
    )
    full = on_gene_axis(rows, genes).join(summed, [*by, "replicate", "gene"], "left").fillna(0.0, ["value"])
    if how == "mean":
        full = full.withColumn("value", F.col("value") / F.col("n_cells"))
    return full.select(*by, "replicate", "gene", "value", "n_cells")


def control_profile(profiles: DataFrame, control: str = CONTROL) -> DataFrame:
    """gene, control: the unweighted mean over the control's profile rows."""
    return profiles.filter(F.col("target_gene") == control).groupBy("gene").agg(F.avg("value").alias("control"))


def delta_vs_control(profiles: DataFrame, control: str = CONTROL) -> DataFrame:
    """target_gene, gene, delta: mean of a label's profile rows minus the control profile."""
    means = (
        profiles.filter(F.col("target_gene") != control)
        .groupBy("target_gene", "gene")
        .agg(F.avg("value").alias("mean"))
    )
    return means.join(control_profile(profiles, control), "gene").select(
        "target_gene", "gene", (F.col("mean") - F.col("control")).alias("delta")
    )


def gene_moments(entries: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """gene, mean, variance over all cells (population form)."""
    n = cells.agg(F.count("*").alias("n")).scalar()
    sums = entries.groupBy("gene").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    )
    return (
        genes.select("gene").join(sums, "gene", "left").fillna(0.0, ["s", "ss"]).withColumn("n", n)
        .select("gene", (F.col("s") / F.col("n")).alias("mean"), pop_var(F.col("ss"), F.col("s"), F.col("n")).alias("variance"))
    )


def moment_sums(entries: DataFrame, by: Sequence[str] = ("target_gene",)) -> DataFrame:
    """by..., gene, s, ss over the stored entries."""
    return entries.groupBy(*by, "gene").agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")
    )


def moments_from_sums(sums: DataFrame, sizes: DataFrame, genes: DataFrame, by: Sequence[str] = ("target_gene",)) -> DataFrame:
    """by..., gene, n, mean, variance on the full grid; zeros count through the group sizes."""
    full = on_gene_axis(sizes, genes).join(sums, [*by, "gene"], "left").fillna(0.0, ["s", "ss"])
    n = F.col("n_cells")
    return full.select(
        *by, "gene_pos", "gene", n.alias("n"), (F.col("s") / n).alias("mean"),
        pop_var(F.col("ss"), F.col("s"), n).alias("variance"),
    )


def label_moments(entries: DataFrame, cells: DataFrame, genes: DataFrame, by: Sequence[str] = ("target_gene",)) -> DataFrame:
    return moments_from_sums(moment_sums(entries, by), group_sizes(cells, by), genes, by)
