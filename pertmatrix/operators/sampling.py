"""Seeded splits, caps and draws. Everything is a function of the seed and the row's own key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.functions.hashing import draw_index, seed_hash
from pertmatrix.matrix import CONTROL
from pertmatrix.operators.cells import filter_labels
from pertmatrix.operators.ranking import shuffled_row_number
from pertmatrix.session import materialized, spread_width

CHUNK = 4096


def count_labels(cells: DataFrame, label: str = "target_gene") -> DataFrame:
    return cells.groupBy(label).agg(F.count("*").alias("n_cells"))


def cap_per_label(
    cells: DataFrame, max_per_label: int | None, max_control: int | None, *, seed: int = 0,
    control: str = CONTROL, label: str = "target_gene", keep: DataFrame | None = None,
) -> DataFrame:
    """At most max_per_label cells of a label (max_control of the control), uniformly without replacement.

    None means no cap. ``keep`` is a one-column label table; the control is always kept.
    """
    if keep is not None:
        chosen = filter_labels(cells.filter(F.col(label) != control), keep, label=label)
        cells = chosen.unionByName(cells.filter(F.col(label) == control))
    unlimited = F.lit(2**62)
    cap_l = unlimited if max_per_label is None else F.lit(max_per_label)
    cap_c = unlimited if max_control is None else F.lit(max_control)
    cap = F.when(F.col(label) == control, cap_c).otherwise(cap_l)
    ranked = shuffled_row_number(cells, [label], seed_hash(seed, label, "cell_id"), "cell_id", at_most=cap)
    return ranked.drop("rank")


def cap_control(cells: DataFrame, max_control: int = 8000, *, seed: int = 0, control: str = CONTROL) -> DataFrame:
    """Cap only the control cells."""
    return cap_per_label(cells, None, max_control, seed=seed, control=control)


def cap_cells(cells: DataFrame, max_cells: int, *, seed: int = 0) -> DataFrame:
    """A uniform sample of max_cells cells, or all of them when there are fewer."""
    ranked = shuffled_row_number(cells, [], seed_hash(seed, "cell_id"), "cell_id", at_most=F.lit(max_cells))
    return ranked.drop("rank")


def carve_holdout(
    cells: DataFrame, n_holdout: int, *, seed: int = 0, min_cells: int = 30, control: str = CONTROL,
    label: str = "target_gene",
) -> DataFrame:
    """Label table (target_gene, n_cells, side) with side train or holdout.

    Eligible labels have at least min_cells cells; n_holdout of them are drawn, or all if fewer.
    Labels that are not eligible stay on the train side. The control is on neither list.
    """
    perts = materialized(count_labels(cells, label).filter(F.col(label) != control), "labels")
    drawn = (
        perts.filter(F.col("n_cells") >= min_cells)
        .orderBy(seed_hash(seed, label), label)
        .limit(n_holdout)
        .select(label, F.lit("holdout").alias("side"))
    )
    return perts.join(drawn, label, "left").withColumn("side", F.coalesce("side", F.lit("train")))


def split_cells(cells: DataFrame, sides: DataFrame, side: str, *, control: str = CONTROL, label: str = "target_gene") -> DataFrame:
    """Cells of one side, plus all control cells: every side is scored against the controls."""
    if side == "all":
        return cells
    if side not in ("train", "holdout"):
        raise ValueError(f"unknown split {side!r}")
    own = filter_labels(cells.filter(F.col(label) != control), keep=sides.filter(F.col("side") == side).select(label), label=label)
    return own.unionByName(cells.filter(F.col(label) == control))


def leave_one_context_out(cells: DataFrame, held_out: str, *, control: str = CONTROL) -> tuple[DataFrame, DataFrame]:
    """(cells of all other contexts, control cells of the held-out context)."""
    sources = cells.filter(F.col("context") != held_out)
    own = cells.filter((F.col("context") == held_out) & (F.col("target_gene") == control))
    return sources, own


def explode_range(df: DataFrame, n_col: str, out: str, *, chunk: int = CHUNK) -> DataFrame:
    """n rows per row, numbered 0..n-1 in ``out``, with ``_chunk``.

    Long ranges are cut into chunks that are spread over tasks before they are expanded, so one
    very large request is not expanded by one task. The number of tasks is stated: by their size adaptive execution would
    join the few chunks into one. Spark takes the result for as small as the chunks, so whoever joins it asks for a merge join.
    """
    cut = df.filter(F.col(n_col) > 0).withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n_col).cast("bigint") - 1, F.lit(chunk).cast("bigint")))
    )
    spread = cut.withColumn("_chunk", F.floor(F.col("_start") / chunk).cast("bigint")).repartition(
        spread_width(df.sparkSession), *[c for c in df.columns if c != n_col], "_chunk"
    )
    last = F.least(F.col("_start") + chunk, F.col(n_col).cast("bigint")) - 1
    return spread.withColumn(out, F.explode(F.sequence(F.col("_start"), last))).drop("_start")


def index_pool(pool: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Pool rows with a dense index ``pool_idx`` from 0 inside each group, in seeded order."""
    hashed = seed_hash(f"pool{seed}", "cell_id")
    ranked = shuffled_row_number(pool, keys, hashed, "cell_id")
    return ranked.withColumn("pool_idx", F.col("rank") - 1).drop("rank")


def draw_with_replacement(
    requests: DataFrame, n_col: str, pool_size: Column, keys: Sequence[str], *, seed: int = 0
) -> DataFrame:
    """Uniform draws: per request row (unique on ``keys``) n numbered draws, each with a ``pool_idx``."""
    draws = explode_range(requests, n_col, "draw_no")
    hashed = seed_hash(f"draw{seed}", *keys, "draw_no")
    return draws.withColumn("pool_idx", draw_index(hashed, pool_size))
