"""Gene axis: id columns, positions, coverage, comparison of axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.session import materialized

# Column names that may carry an id space, in order of preference.
ID_ALIASES = {
    "ensembl_gene_id": ("ensembl_gene_id", "ensembl_id", "ensembl", "gene_id", "gene_ids"),
    "hgnc_symbol": ("hgnc_symbol", "gene_symbol", "symbol", "gene_name", "gene_names"),
}
ENSEMBL_PATTERN = r"^ENSG\d{11}"


def id_shape(col: str, id_type: str) -> Column:
    """Does the value look like an id of this space? Symbols only need to be nonempty."""
    if id_type not in ID_ALIASES:
        raise ValueError(f"unknown id type {id_type!r}; known: {sorted(ID_ALIASES)}")
    text = F.coalesce(F.col(col).cast("string"), F.lit("None"))
    if id_type == "ensembl_gene_id":
        return text.rlike(ENSEMBL_PATTERN)
    return (F.length(text) > 0) & ~text.isin("nan", "None", "")


def id_candidates(genes: DataFrame, id_type: str, index_col: str = "gene") -> DataFrame:
    """candidate, ord, valid_fraction for every column that may hold the id space, the index last."""
    names = [c for c in ID_ALIASES.get(id_type, ()) if c in genes.columns and c != index_col] + [index_col]
    fractions = genes.agg(*[F.avg(id_shape(c, id_type).cast("double")).alias(c) for c in names])
    rows = F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.lit(i).cast("bigint").alias("ord"), F.coalesce(F.col(c), F.lit(0.0)).alias("valid_fraction"))
        for i, c in enumerate(names)
    ])
    return fractions.select(F.inline(rows))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The candidate with the highest fraction; the earlier alias wins a tie."""
    return candidates.orderBy(F.desc("valid_fraction"), "ord").limit(1)


def resolve_id_column(genes: DataFrame, id_type: str, *, min_valid: float = 0.9, index_col: str = "gene") -> str:
    """Name of the column that holds the id space. Raises when none is valid enough."""
    best = best_candidate(id_candidates(genes, id_type, index_col)).first()
    if best.valid_fraction < min_valid:
        raise ValueError(
            f"{id_type}: {best.candidate!r} comes closest with {best.valid_fraction:.1%} of its values in shape; columns: {genes.columns}"
        )
    return best.candidate


def gene_index(axis: DataFrame, id_col: str) -> DataFrame:
    """gene_id, gene_pos, n_seen: an id listed twice keeps its first position.

    Written once: joins then know its true size, and Spark broadcasts it only if that is small.
    """
    index = axis.groupBy(F.col(id_col).cast("string").alias("gene_id")).agg(
        F.min("gene_pos").alias("gene_pos"), F.count("*").alias("n_seen")
    )
    return materialized(index, "gene-index")


def to_positions(ids: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Known ids with their position; unknown ids drop."""
    return ids.join(index.select(F.col("gene_id").alias(id_col), "gene_pos"), id_col)


def coverage(ids: DataFrame, index: DataFrame, id_col: str, by: Sequence[str] = ()) -> DataFrame:
    """by..., n_ids, n_known, coverage; every occurrence counts. Empty input has coverage 0.

    Occurrences are counted per id before the join, so a frequent id is one row there.
    """
    known = index.select(F.col("gene_id").alias(id_col), F.lit(True).alias("_known"))
    seen = ids.groupBy(*by, id_col).agg(F.count("*").alias("_n")).join(known, id_col, "left")
    counted = seen.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_ids"), F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("n_known")
    )
    return counted.withColumn("coverage", F.when(F.col("n_ids") > 0, F.col("n_known") / F.col("n_ids")).otherwise(F.lit(0.0)))


def coverage_verdict(cov: DataFrame, *, min_frac: float = 0.5, raise_below: float = 0.0) -> DataFrame:
    """Adds verdict: error, warning or ok."""
    return cov.withColumn(
        "verdict",
        F.when(F.col("coverage") <= raise_below, "error").when(F.col("coverage") < min_frac, "warning").otherwise("ok"),
    )


def require_coverage(ids: DataFrame, index: DataFrame, id_col: str, source: str, **limits: float) -> float:
    """The covered fraction; raises when it counts as an error."""
    row = coverage_verdict(coverage(ids, index, id_col), **limits).first()
    if row.verdict == "error":
        raise ValueError(f"{source}: {row.n_known} of {row.n_ids} ids are known; these ids are of another kind")
    return row.coverage


def axis_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """gene_pos, gene_a, gene_b wherever two axes differ, in genes or in order."""
    left = a.select("gene_pos", F.col("gene").alias("gene_a"))
    right = b.select("gene_pos", F.col("gene").alias("gene_b"))
    return left.join(right, "gene_pos", "full").filter(~F.col("gene_a").eqNullSafe(F.col("gene_b")))


def require_same_axis(a: DataFrame, b: DataFrame) -> None:
    if not axis_differences(a, b).isEmpty():
        raise ValueError("gene axes differ (genes or order)")
