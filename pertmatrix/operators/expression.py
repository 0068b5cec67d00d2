"""Differential expression: rank test against the controls, and false discovery rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from pertmatrix.functions.normal import two_sided_p
from pertmatrix.matrix import CONTROL
from pertmatrix.operators.pseudobulk import group_sizes, value_histogram
from pertmatrix.operators.ranking import running_total


def wilcoxon(
    entries: DataFrame, cells: DataFrame, genes: DataFrame, *, by: Sequence[str] = (), control: str = CONTROL
) -> DataFrame:
    """by..., target_gene, gene, n_pert, n_ctrl, u, z: rank sum of a label's cells against the controls.

    Works on value histograms, zeros included: the controls' running count is built once per gene
    and joined by value, so no control cell is repeated for a label. Ties are mid-ranked and the
    variance is corrected for them; control-only ties come from one total per gene.
    """
    by = list(by)
    sizes = group_sizes(cells, [*by, "target_gene"])
    hist = value_histogram(entries, sizes, genes, [*by, "target_gene"])
    is_ctrl = F.col("target_gene") == control

    # every value any label has at the gene, with the number of control cells that have it
    at_value = hist.groupBy(*by, "gene", "value").agg(
        F.coalesce(F.sum(F.when(is_ctrl, F.col("freq"))), F.lit(0)).alias("c")
    )
    below = running_total(at_value, [*by, "gene"], "value", "c")
    cube = lambda x: x.cast("double") * x.cast("double") * x.cast("double") - x.cast("double")
    ctrl_ties = at_value.groupBy(*by, "gene").agg(F.sum(cube(F.col("c"))).alias("ctrl_ties"))

    n, c = F.col("freq"), F.col("c")
    ranked = (
        hist.filter(~is_ctrl).join(below, [*by, "gene", "value"]).groupBy(*by, "target_gene", "gene")
        .agg(
            F.sum(n * (F.col("before") + c / 2.0)).alias("u"),
            F.sum(cube(n + c) - cube(c)).alias("more_ties"),
            F.sum(n).alias("n_pert"),
        )
    )
    n_ctrl = sizes.filter(is_ctrl).select(*by, F.col("n_cells").alias("n_ctrl"))
    if by:
        ranked = ranked.join(n_ctrl, by)
    else:
        ranked = ranked.withColumn("n_ctrl", n_ctrl.scalar())
    n1, n2 = F.col("n_pert").cast("double"), F.col("n_ctrl").cast("double")
    total = n1 + n2
    ties = F.col("ctrl_ties") + F.col("more_ties")
    spread = n1 * n2 / 12.0 * (total + 1.0 - ties / (total * (total - 1.0)))
    z = F.when(spread > 0, (F.col("u") - n1 * n2 / 2.0) / F.sqrt(spread)).otherwise(F.lit(0.0))
    return ranked.join(ctrl_ties, [*by, "gene"]).select(*by, "target_gene", "gene", "n_pert", "n_ctrl", "u", z.alias("z"))


def with_fdr(tests: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Adds p (two-sided) and fdr (Benjamini-Hochberg within a label; one row per gene)."""
    rows = tests.withColumn("p", two_sided_p("z"))
    label = [*by, "target_gene"]
    rank = F.row_number().over(W.partitionBy(*label).orderBy("p", "gene"))
    size = F.count("*").over(W.partitionBy(*label))
    scaled = rows.withColumn("_q", F.col("p") * size / rank)
    from_largest = W.partitionBy(*label).orderBy(F.desc("p"), F.desc("gene")).rowsBetween(W.unboundedPreceding, 0)
    return scaled.withColumn("fdr", F.least(F.lit(1.0), F.min("_q").over(from_largest))).drop("_q")
