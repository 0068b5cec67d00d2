"""Output contract: what a finished set of predicted cells must satisfy. Breaches are rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.functions.columns import finite_or_zero
from pertmatrix.matrix import CONTROL, axis_lookup


class ContractError(ValueError):
    """The output breaks its contract."""


@dataclass(frozen=True)
class Contract:
    """``genes``: gene_pos, gene in order. ``perts``: target_gene. Caps are the published defaults."""

    genes: DataFrame
    perts: DataFrame
    contexts: tuple[str, ...]
    cells_per_pert: int = 400
    control: str = CONTROL
    max_counts_per_cell: float = 1_000_000
    max_cells: int = 400_000
    max_stored_entries: int = 4_750_000_000


def _broken(df: DataFrame, rule: str, count: Column, when: Column | None = None) -> DataFrame:
    """One row (rule, n) when the condition holds (by default: when the count is positive)."""
    row = df.agg(count.cast("bigint").alias("n"))
    return row.filter("n > 0" if when is None else when).select(F.lit(rule).alias("rule"), "n")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require_none(violations: DataFrame) -> None:
    """Raise with the broken rules, or return. The table has one row per rule."""
    rows = violations.orderBy("rule").collect()
    if rows:
        raise ContractError("; ".join(f"{r.rule} ({r.n})" for r in rows))


def contract_violations(c: Contract) -> DataFrame:
    """rule, n: is the contract itself sound?"""
    def doubled(df: DataFrame, col: str) -> DataFrame:
        return df.groupBy(col).agg(F.count("*").alias("k")).filter("k > 1")

    size = F.count("*") * (len(c.contexts) * c.cells_per_pert)
    return _all([
        _broken(doubled(c.genes, "gene"), "duplicate gene", F.count("*")),
        _broken(doubled(c.perts, "target_gene"), "duplicate perturbation", F.count("*")),
        _broken(c.perts.filter(F.col("target_gene") == c.control), "control listed as perturbation", F.count("*")),
        _broken(c.perts, "contract exceeds the cell cap", size, F.col("n") > c.max_cells),
    ])


def value_violations(c: Contract, cells: DataFrame, entries: DataFrame, tasks: int | None = None) -> DataFrame:
    """rule, n over cells (cell_id, context, target_gene) and stored entries (cell_id, gene, value).

    Explicit zeros are removed first. One pass and one exchange by cell check all rules on entries. ``tasks``: how many
    tasks it deals them over; entries that lie so already are not shuffled again. Without it Spark goes by their bytes.
    """
    stored = entries.filter((F.col("value") != 0) | F.isnan("value") | F.col("value").isNull())
    v = F.col("value")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    good = ~bad & v.isNotNull()
    axis = axis_lookup(c.genes).select("gene", F.lit(True).alias("_known"))
    per_entry = stored.join(axis, "gene", "left").repartition(*([tasks] if tasks else []), "cell_id").groupBy("cell_id", "gene").agg(
        F.count("*").alias("_times"), F.count_if(v.isNull()).alias("missing"), F.count_if(bad).alias("not_finite"),
        F.count_if(good & (v < 0)).alias("negative"), F.count_if(good & (v != F.rint(v))).alias("fractional"),
        F.sum(finite_or_zero(v)).alias("total"), F.count_if(F.col("_known").isNull()).alias("strange"),
    )
    per_cell = per_entry.groupBy("cell_id").agg(
        *[F.sum(k).alias(k) for k in ("missing", "not_finite", "negative", "fractional", "total", "strange")],
        F.sum("_times").alias("nnz"), F.sum(F.col("_times") - 1).alias("doubled"),
    )
    homed = cells.select("cell_id").distinct().withColumn("_homed", F.lit(True))
    totals = per_cell.join(homed, "cell_id", "left").agg(
        F.sum("missing").alias("missing values"), F.sum("doubled").alias("doubled entries"),
        F.sum(F.when(F.col("_homed").isNull(), F.col("nnz"))).alias("entries without a cell"),
        F.sum("strange").alias("gene not on the axis"), F.sum("not_finite").alias("non-finite values"), F.sum("negative").alias("negative values"),
        F.sum("fractional").alias("fractional values"),
        F.count_if(F.col("total") > c.max_counts_per_cell).alias("cell total over the cap"),
        F.when(F.sum("nnz") > c.max_stored_entries, F.sum("nnz")).alias("density cap exceeded"),
    )
    rules = totals.columns
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").cast("bigint").alias("n")) for r in rules])
    in_values = totals.select(F.inline(pairs)).filter("n > 0")
    labels = cells.groupBy("target_gene").agg(F.count("*").alias("_n"))
    return _all([
        in_values,
        _broken(cells.filter(~F.col("context").isin(*c.contexts)), "unknown context", F.count("*")),
        _broken(labels.join(c.perts, "target_gene", "left_anti"), "unknown perturbation", F.sum("_n")),
        _broken(cells, "cell cap exceeded", F.count("*"), F.col("n") > c.max_cells),
    ])


def expected_blocks(c: Contract) -> DataFrame:
    """context, target_gene: every listed perturbation in every context."""
    contexts = F.array(*[F.lit(x) for x in c.contexts])
    return c.perts.select(F.explode(contexts).alias("context"), "target_gene")


def block_differences(c: Contract, cells: DataFrame) -> DataFrame:
    """problem, context, target_gene, n_cells: missing, unexpected or wrongly sized blocks."""
    blocks = cells.groupBy("context", "target_gene").agg(F.count("*").alias("n_cells"))
    want = expected_blocks(c).withColumn("_want", F.lit(True))
    both = blocks.join(want, ["context", "target_gene"], "full").fillna({"n_cells": 0})
    problem = (
        F.when(F.col("_want").isNull(), "unexpected")
        .when(F.col("n_cells") == 0, "missing")
        .when(F.col("n_cells") != c.cells_per_pert, "wrong count")
    )
    return both.select(problem.alias("problem"), "context", "target_gene", "n_cells").filter(F.col("problem").isNotNull())


def completeness_violations(c: Contract, cells: DataFrame) -> DataFrame:
    """rule, n: block problems by kind, control rows, and cell ids that stand more than once."""
    blocks = block_differences(c, cells).groupBy(F.concat("problem", F.lit(" block")).alias("rule")).agg(F.count("*").alias("n"))
    control = _broken(cells.filter(F.col("target_gene") == c.control), "control rows present", F.count("*"))
    doubled = _broken(cells.groupBy("cell_id").agg(F.count("*").alias("k")).filter("k > 1"), "doubled cell", F.count("*"))
    return _all([blocks, control, doubled])


def write_summary(cells: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: n_cells, nnz, max_row_total, median_nnz over all cells (those without entries count 0)."""
    per_cell = entries.filter("value != 0").groupBy("cell_id").agg(F.sum("value").alias("total"), F.count("*").alias("nnz"))
    full = cells.select("cell_id").join(per_cell, "cell_id", "left").fillna({"total": 0.0, "nnz": 0})
    return full.agg(
        F.count("*").alias("n_cells"), F.sum("nnz").alias("nnz"), F.max("total").alias("max_row_total"),
        F.median("nnz").alias("median_nnz"),
    )


def attach_controls(pred_cells: DataFrame, pred_entries: DataFrame, real_cells: DataFrame, real_entries: DataFrame, control: str = CONTROL) -> tuple[DataFrame, DataFrame]:
    """Prediction plus the real control cells, under new string ids; other cell columns are dropped.

    Check the axes with ``require_same_axis`` first.
    """
    own = real_cells.filter(F.col("target_gene") == control)

    def cells(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col("cell_id").cast("string")).alias("cell_id"), "target_gene")

    def entries(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col("cell_id").cast("string")).alias("cell_id"), "gene", "value")

    ctrl_entries = real_entries.join(own.select("cell_id"), "cell_id", "left_semi")
    return (
        cells(pred_cells, "pred_").unionByName(cells(own, "ctrl_")),
        entries(pred_entries, "pred_").unionByName(entries(ctrl_entries, "ctrl_")),
    )
