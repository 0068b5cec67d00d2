"""Predictors: what a model of perturbation effects has to fill in, the three given rungs, and the check of what it returns.

A model learns from label moments (``pseudobulk.label_moments`` of log-normalised values) and answers with a table of
deltas on the full grid. Everything after that (cells, tests, scores) treats all models alike, in one plan.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, functions as F

from pertmatrix.matrix import on_gene_axis
from pertmatrix.operators import predictors as R
from pertmatrix.session import materialized

COLUMNS = ("target_gene", "gene_pos", "gene", "delta")
SEPARATOR = "|"


class Predictor(ABC):
    """A model with a ``name``. ``fit`` returns whatever ``deltas`` needs, as a rule small tables; neither sees the held-out cells."""

    name: str

    @abstractmethod
    def fit(self, moments: DataFrame) -> Any:
        """What is learnt from target_gene, gene_pos, gene, n, mean, variance of the training cells, controls included."""

    @abstractmethod
    def deltas(self, fitted: Any, requested: DataFrame, genes: DataFrame) -> DataFrame:
        """target_gene, gene_pos, gene, delta: one row for every requested label (one column, target_gene) and every gene."""


class Unchanged(Predictor):
    """Rung 0: labels look like the controls."""

    name = "rung0"

    def fit(self, moments):
        return None

    def deltas(self, fitted, requested, genes):
        return R.zero_delta(requested, genes)


class MeanResponse(Predictor):
    """Rung 0b: every label gets the mean response of all perturbed training cells."""

    name = "rung0b"

    def fit(self, moments):
        return R.mean_perturbation_delta(moments)

    def deltas(self, fitted, requested, genes):
        return R.same_delta_for(requested, fitted)


class Backbone(Predictor):
    """Rung 1: responsive genes move by their mean effect, the label's own gene by the learnt knockdown."""

    name = "rung1"

    def __init__(self, *, scale: float = 1.0, min_cells: int = 10):
        self.scale, self.min_cells = scale, min_cells

    def fit(self, moments):
        seen = R.training_deltas(moments, min_cells=self.min_cells)
        return R.backbone_features(seen), R.mean_self_knockdown(seen)

    def deltas(self, fitted, requested, genes):
        return R.backbone_delta(requested, *fitted, scale=self.scale)


RUNGS: tuple[Predictor, ...] = (Unchanged(), MeanResponse(), Backbone())


def _same_kind(name: str, df: DataFrame) -> DataFrame:
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"model {name!r} returns no {missing}")
    return df.select(F.lit(name).alias("model"), "target_gene", F.col("gene_pos").cast("bigint").alias("gene_pos"), "gene", F.col("delta").cast("double").alias("delta"))


def delta_violations(deltas: DataFrame, names: Sequence[str], requested: DataFrame, genes: DataFrame) -> DataFrame:
    """model, rule, n over the deltas of the named models, all set against the same grid of requested labels and genes."""
    grid = on_gene_axis(requested.select("target_gene").distinct(), genes)
    wanted = grid.select(F.explode(F.array(*[F.lit(n) for n in names])).alias("model"), "target_gene", "gene_pos", "gene", F.lit(1).alias("_want"))
    found = deltas.groupBy("model", "target_gene", "gene_pos", "gene").agg(
        F.count("*").alias("k"), F.count_if(F.col("delta").isNull() | F.isnan("delta") | (F.abs("delta") == float("inf"))).alias("bad")
    )
    # null-safe, so a row without a label or gene is seen as one that was not asked for
    keys = ["model", "target_gene", "gene_pos", "gene"]
    w, f = wanted.alias("w"), found.alias("f")
    both = w.join(f, reduce(lambda a, b: a & b, [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys]), "full")
    want, k = F.col("_want").isNotNull(), F.col("k")
    row = both.groupBy(F.coalesce("w.model", "f.model").alias("model")).agg(
        F.count_if(want & k.isNull()).alias("no delta for a requested label and gene"),
        F.count_if(~want).alias("delta that was not requested"),
        F.count_if(k > 1).alias("more than one delta"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("delta is not a number"),
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").alias("n")) for c in row.columns[1:]])
    return row.select("model", F.inline(pairs)).filter("n > 0")


def predicted_deltas(models: Sequence[Predictor], moments: DataFrame, requested: DataFrame, genes: DataFrame) -> DataFrame:
    """model, target_gene, gene_pos, gene, delta of all models, fitted on the same moments and checked together.

    Two models of one name, a name with ``|``, and deltas that do not cover the requested grid exactly once are errors.
    """
    names = [m.name for m in models]
    doubled = sorted({n for n in names if names.count(n) > 1})
    if not names or doubled or any(SEPARATOR in n for n in names):
        raise ValueError(f"model names must be given, different and without {SEPARATOR!r}: {names}")
    moments = materialized(moments, "training-moments")
    parts = [_same_kind(m.name, m.deltas(m.fit(moments), requested, genes)) for m in models]
    deltas = materialized(reduce(DataFrame.unionByName, parts), "model-deltas")
    found = sorted((r.model, r.rule, r.n) for r in delta_violations(deltas, names, requested, genes).collect())
    if found:
        raise ValueError(f"deltas do not fit: {found}")
    return deltas
