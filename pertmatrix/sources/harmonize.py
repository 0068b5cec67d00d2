"""A source's own column names, control label and id space brought to the canonical three tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from pertmatrix.matrix import CONTROL, CountMatrix

REQUIRED = ("cell_id", "pert_col", "control_label")


def _check(spec: Mapping[str, str], df: DataFrame) -> None:
    missing = [k for k in REQUIRED if not spec.get(k)]
    if missing:
        raise ValueError(f"spec lacks {missing}")
    absent = [spec[k] for k in ("cell_id", "pert_col", "context_col") if spec.get(k) and spec[k] not in df.columns]
    if absent:
        raise KeyError(f"columns named by the spec are missing: {absent}; have {df.columns}")


def harmonize_cells(raw: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """cell_id, target_gene, context from a raw cell table.

    ``spec``: cell_id, pert_col, control_label; either context_col (with an optional
    context_prefix) or a fixed context.
    """
    _check(spec, raw)
    label = F.col(spec["pert_col"]).cast("string")
    if spec.get("context_col"):
        context = F.concat(F.lit(spec.get("context_prefix", "")), F.col(spec["context_col"]).cast("string"))
    else:
        context = F.lit(spec.get("context"))
    return raw.select(
        F.col(spec["cell_id"]).alias("cell_id"),
        F.when(label == spec["control_label"], F.lit(CONTROL)).otherwise(label).alias("target_gene"),
        context.alias("context"),
    )


def harmonize(
    raw_cells: DataFrame, raw_genes: DataFrame, raw_expr: DataFrame, spec: Mapping[str, str], id_map: DataFrame | None = None
) -> CountMatrix:
    """The canonical matrix. Without a gene_id_col in the spec, ids come from ``id_map`` (gene, ensembl_id)."""
    genes = raw_genes.select("gene_pos", "gene", *([F.col(spec["gene_id_col"]).alias("ensembl_id")] if spec.get("gene_id_col") else []))
    if not spec.get("gene_id_col"):
        if id_map is None:
            raise ValueError("spec has no gene_id_col and no id map was given")
        one = id_map.groupBy("gene").agg(F.min("ensembl_id").alias("ensembl_id"))
        genes = genes.join(one, "gene", "left").select("gene_pos", "gene", "ensembl_id")
    expr = raw_expr.select(F.col(spec["cell_id"]).alias("cell_id"), "gene", F.col("value").cast("double").alias("value"))
    return CountMatrix(harmonize_cells(raw_cells, spec), genes, expr)
