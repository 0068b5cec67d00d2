"""Mixing to target weights by iterative proportional fitting.

Token weights of the cells (source x language x topic, summed before anything is shuffled by source) are raked
until their sums along each dimension match the targets. The quotient of raked and own weight is how much a cell
must be over- or under-drawn; scaled so that the neediest cell is taken whole, it is the probability with which
each document of the cell is sampled, by a seeded hash of its id.
"""

from __future__ import annotations

import functools
import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from pertmatrix.functions.hashing import draw_index, seed_hash
from pertmatrix.session import materialized

NONE = "(none)"
_DRAWS = 1_000_000_000
#: Relative error at which a marginal meets its target, and sweeps before an error that no longer falls counts as final.
TOLERANCE, SETTLED = 1e-3, 48


def text_topic(text: Column) -> Column:
    """A stand-in for a topic where the table has none: what kind of thing the text carries."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(t, F.lit("icense")), "licensed").when(F.contains(t, F.lit("@")), "contact")
        .when(F.length(t) >= 4000, "long prose").when(F.length(t) >= 1000, "prose").otherwise("short prose")
    )


def cell_weights(docs: DataFrame, dims: list[str], tokens: Column) -> DataFrame:
    """Tokens per cell; a null value of a dimension is the value ``(none)``, null tokens are 0."""
    return docs.groupBy(*[F.coalesce(F.col(d), F.lit(NONE)).alias(d) for d in dims]).agg(F.sum(F.coalesce(tokens, F.lit(0))).cast("double").alias("weight"))


def tempered_targets(cells: DataFrame, dims: list[str], power: float) -> dict[str, DataFrame]:
    """Targets (value, share) for each dimension: own token counts to a power below 1, which lifts small values."""
    return {d: cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("weight"), F.lit(power)).alias("share")) for d in dims}


def _swept(cells: DataFrame, dims: list[str], sweeps: int) -> DataFrame:
    for _ in range(sweeps):
        for d in dims:
            cells = cells.withColumn("raked", F.coalesce(F.col("raked") * F.col(f"_share_{d}") / F.nullif(F.sum("raked").over(Window.partitionBy(d)), F.lit(0.0)), F.lit(0.0)))
    return cells


def _worst(cells: DataFrame, dims: list[str]) -> tuple[float, str, str]:
    """(error, dimension, value) of the value with a target whose share of the raked weights is relatively farthest from it."""
    found = []
    for d in dims:
        each = cells.groupBy(F.col(d).alias("value")).agg(F.sum("raked").alias("have"), F.max(f"_share_{d}").alias("want"))
        total = each.agg(F.sum("have").alias("all_have"), F.sum("want").alias("all_want"))
        quotient = F.coalesce(F.col("have") / F.nullif(F.col("all_have"), F.lit(0.0)), F.lit(0.0)) * F.col("all_want") / F.col("want")
        found.append(each.where("want > 0").crossJoin(total).agg(F.max(F.struct(F.abs(quotient - 1).alias("error"), F.lit(d).alias("dim"), "value")).alias("w")))
    worst = functools.reduce(DataFrame.unionByName, found).agg(F.max("w").alias("w")).first()["w"]
    return tuple(worst) if worst else (0.0, "", "")


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 6, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (dims, weight) with ``raked``: the weights after proportional fitting.

    After each ``sweeps`` rounds the cells are written and held against the targets, until no marginal is off by more
    than ``tolerance`` of its target. Where targets contradict each other no weights meet them: if twice the rounds
    leave the error as it was, the fit ends with a warning that names it. Shares count relative to their sum over the
    values that have cells. Values without a target have none, so their cells get the raked weight 0; so do cells
    without tokens.
    """
    out = cells
    for d, target in targets.items():
        out = out.join(target.groupBy(F.col("value").alias(d)).agg(F.sum("share").alias(f"_share_{d}")), d, "left").fillna(0.0, [f"_share_{d}"])
    dims = list(targets)
    out = materialized(_swept(out.withColumn("raked", F.col("weight")), dims, sweeps), "mix-raked")
    done = looked = sweeps
    worst = _worst(out, dims)
    then = worst[0]
    while worst[0] > tolerance:
        out = materialized(_swept(out, dims, sweeps), "mix-raked")
        done, worst = done + sweeps, _worst(out, dims)
        if done >= max(SETTLED, 2 * looked):
            if worst[0] > tolerance and worst[0] > 0.99 * then:
                warnings.warn(f"targets contradict each other: after {done} sweeps {worst[1]} {worst[2]!r} is {worst[0]:.2%} off its target", stacklevel=2)
                break
            looked, then = done, worst[0]
    return out.select(*cells.columns, "raked")


def mix(
    docs: DataFrame, dims: dict[str, Column], tokens: Column, targets: dict[str, DataFrame] | None = None, power: float = 0.7, seed: int = 0,
    id_col: str = "doc_id", sweeps: int = 6, prefix: str = "_m_",
) -> DataFrame:
    """``docs`` with its own columns first, then with ``prefix``: one column per dimension, tokens, probability, kept.

    ``dims`` names the dimensions and gives their values, ``tokens`` a document's tokens. ``targets`` has
    (value, share) per dimension; without it the targets are the own shares to ``power``. Documents of values
    without a target are never drawn; documents in cells without tokens are always, as they weigh nothing. Targets
    are met to TOLERANCE, looked at every ``sweeps`` rounds of ``rake``, which warns of targets that contradict each other.
    Rows with the same id have the same draw, null ids included; all rows are judged. Columns of ``docs`` that
    begin with ``prefix`` are not allowed.
    """
    if clash := [c for c in docs.columns if c.startswith(prefix)]:
        raise ValueError(f"columns {clash} begin with the prefix {prefix!r}; choose another prefix")
    names = [f"{prefix}{d}" for d in dims]
    placed = docs.withColumns({n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, dims.values())}).withColumn(f"{prefix}tokens", F.coalesce(tokens, F.lit(0)).cast("bigint"))
    cells = materialized(cell_weights(placed, names, F.col(f"{prefix}tokens")), "mix-cells")
    wanted = {f"{prefix}{d}": t for d, t in targets.items()} if targets else tempered_targets(cells, names, power)
    raked = rake(cells, wanted, sweeps).withColumn("_need", F.col("raked") / F.nullif(F.col("weight"), F.lit(0.0)))
    most = raked.agg(F.max("_need").alias("_most")).scalar()
    chance = materialized(
        raked.select(*names, F.coalesce(F.round(F.col("_need") / most, 9), F.when(F.col("weight") == 0, F.lit(1.0)).otherwise(0.0)).alias(f"{prefix}probability")),
        "mix-chances",
    )
    draw = draw_index(seed_hash(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(_DRAWS)) / F.lit(_DRAWS)
    out = placed.join(chance, names, "left")
    return out.select(*docs.columns, *names, f"{prefix}tokens", f"{prefix}probability", (draw < F.col(f"{prefix}probability")).alias(f"{prefix}kept"))
