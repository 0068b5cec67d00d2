"""Dataset profiles: label statistics, matrix statistics, overlap of label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pertmatrix.functions.columns import is_whole
from pertmatrix.matrix import CONTROL, CountMatrix
from pertmatrix.operators.axis import coverage
from pertmatrix.operators.cells import cell_libsize, counts_state
from pertmatrix.operators.ranking import exact_quantiles
from pertmatrix.operators.sampling import count_labels
from pertmatrix.session import materialized

MIN_CELL_STEPS = (10, 30, 50, 100)


def profile_dataset(matrix: CountMatrix, control: str = CONTROL) -> DataFrame:
    """One row: sizes, control share, cells per perturbation, and distinct values of other columns.

    One pass over the cells counts the values of all columns; a hot value is combined before it is shuffled.
    """
    others = [c for c in matrix.cells.columns if c not in ("cell_id", "cell_ord", "target_gene")]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in ["target_gene", *others]])
    seen = materialized(matrix.cells.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n_cells")), "column-values")
    labels = seen.filter("column = 'target_gene'").select(F.col("value").alias("target_gene"), "n_cells")
    pert = F.col("target_gene") != control
    n = F.when(pert, F.col("n_cells"))
    q = lambda p: F.percentile(n, F.lit(p))
    stats = labels.agg(
        F.sum("n_cells").alias("n_cells"),
        F.count_if(pert).alias("n_perturbations"),
        F.coalesce(F.sum(F.when(~pert, F.col("n_cells"))), F.lit(0)).alias("n_control_cells"),
        F.min(n).alias("min_cells"), q(0.25).alias("p25_cells"), q(0.5).alias("median_cells"), q(0.75).alias("p75_cells"),
        F.max(n).alias("max_cells"),
        *[F.count_if(pert & (F.col("n_cells") >= k)).alias(f"perts_ge_{k}") for k in MIN_CELL_STEPS],
    )
    measured = labels.filter(pert).join(matrix.genes.select(F.col("gene").alias("target_gene")), "target_gene", "left_semi")
    row = stats.withColumn("control_fraction", F.col("n_control_cells") / F.col("n_cells")).withColumn(
        "n_genes", matrix.genes.agg(F.count("*").alias("n")).scalar()
    ).withColumn("n_perts_measured", measured.agg(F.count("*").alias("n")).scalar())
    distinct = seen.agg(*[F.count_if((F.col("column") == c) & F.col("value").isNotNull()).alias(f"n_unique_{c}") for c in others] or [F.count("*").alias("_")])
    return row.withColumns({f"n_unique_{c}": distinct.select(f"n_unique_{c}").scalar() for c in others}) if others else row


def profile_matrix(matrix: CountMatrix) -> DataFrame:
    """One row of count statistics over every cell, empty ones included."""
    full = materialized(_cell_facts(matrix), "cell-facts")
    umi, detected = (exact_quantiles(full, [], c, [0.5]).select(F.col("q")[0]).scalar() for c in ("total", "detected"))
    row = full.agg(
        F.min("whole").alias("integral_counts"), F.max("top").alias("value_max"),
        F.min("total").alias("umi_min"), F.max("total").alias("umi_max"), F.count("*").alias("n"), F.sum("detected").alias("nnz"),
    ).withColumns({"g": matrix.genes.agg(F.count("*").alias("g")).scalar(), "umi_median": umi, "median_genes_detected": detected})
    row = row.withColumn("pct_zeros", 100.0 * (1.0 - F.col("nnz") / (F.col("n") * F.col("g"))))
    return row.select("integral_counts", "value_max", "umi_min", "umi_median", "umi_max", "median_genes_detected", "pct_zeros")


def _cell_facts(matrix: CountMatrix) -> DataFrame:
    """total, detected, top, whole of every cell; of packed rows without a shuffle."""
    if matrix.rows is not None:
        value = F.col("entries.value")
        return matrix.rows.select(
            F.col("libsize").alias("total"), F.size("entries").cast("bigint").alias("detected"), F.coalesce(F.array_max(value), F.lit(0.0)).alias("top"),
            F.forall(value, is_whole).alias("whole"),
        )
    per_cell = matrix.expr.groupBy("cell_id").agg(
        F.sum("value").alias("total"), F.count("*").alias("detected"),
        F.max("value").alias("top"), F.min(is_whole(F.col("value"))).alias("whole"),
    )
    return matrix.cells.select("cell_id").join(per_cell, "cell_id", "left").fillna({"total": 0.0, "detected": 0, "top": 0.0, "whole": True}).drop("cell_id")


def distinct_labels(cells: DataFrame) -> DataFrame:
    return cells.select("target_gene").distinct().orderBy("target_gene")


def shared_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels present in both one-column tables."""
    return a.intersect(b)


def perturbed_and_measured(cells: DataFrame, genes: DataFrame, control: str = CONTROL) -> DataFrame:
    """One row: n_measured of n_perturbations labels are also measured genes."""
    perts = cells.filter(F.col("target_gene") != control).select("target_gene").distinct()
    known = genes.select(F.col("gene").alias("target_gene"), F.lit(1).alias("_m"))
    return perts.join(known, "target_gene", "left").agg(
        F.count("_m").alias("n_measured"), F.count("*").alias("n_perturbations")
    )


def subset_report(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """One row: cells, genes, labels, and min/median cells per label of an extracted subset."""
    return count_labels(cells).agg(
        F.sum("n_cells").alias("n_cells"), F.count("*").alias("n_labels"),
        F.min("n_cells").alias("min_per_label"), F.median("n_cells").alias("median_per_label"),
    ).withColumn("n_genes", genes.agg(F.count("*").alias("n")).scalar())


def qc_report(matrix: CountMatrix, known_genes: DataFrame, id_col: str, control: str = CONTROL) -> DataFrame:
    """One row of admission facts: sizes, counts state, empty cells, id coverage."""
    labels = count_labels(matrix.cells)
    is_ctrl = F.col("target_gene") == control
    row = labels.agg(
        F.sum("n_cells").alias("n_cells"), F.count_if(~is_ctrl).alias("n_perturbations"),
        F.coalesce(F.sum(F.when(is_ctrl, F.col("n_cells"))), F.lit(0)).alias("n_control_cells"),
    )
    state = counts_state(matrix.expr, matrix.cells).select("state").scalar()
    empty = cell_libsize(matrix).filter("libsize = 0").agg(F.count("*").alias("n")).scalar()
    share = coverage(matrix.genes, known_genes, id_col).select("coverage").scalar()
    return row.withColumn("state", state).withColumn("n_empty_cells", empty).withColumn("id_coverage", share)
