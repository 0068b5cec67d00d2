"""Scores of a prediction against the real labels. Long tables: target_gene, metric, value."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pertmatrix.functions.columns import pop_var
from pertmatrix.matrix import CONTROL
from pertmatrix.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

HIGHER_IS_BETTER = {
    "mae": False, "mse": False, "pearson_delta": True, "pds_l1": True, "pds_cosine": True, "overlap_at_n": True,
    "precision_at_n": True, "sig_jaccard": True, "lfc_nmae": False, "direction_agreement": True, "direction_fidelity": True,
}
# Labels per block of the discrimination score: 256 x 20,000 genes x 8 bytes is 41 MB a side.
BLOCK = 256


def check_metric_names(names: Sequence[str]) -> list[str]:
    unknown = sorted(set(names) - set(HIGHER_IS_BETTER))
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}; known: {sorted(HIGHER_IS_BETTER)}")
    return list(names)


def paired(pred: DataFrame, real: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., target_gene, gene, pred, real from two (by..., target_gene, gene, delta) tables."""
    keys = [*by, "target_gene", "gene"]
    return pred.select(*keys, F.col("delta").alias("pred")).join(real.select(*keys, F.col("delta").alias("real")), keys)


def error_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., target_gene, mae, mse, pearson_delta in one aggregation (correlation NULL without spread)."""
    d = F.col("pred") - F.col("real")
    flat = (F.max("pred") == F.min("pred")) | (F.max("real") == F.min("real"))
    spread = F.stddev_pop("pred") * F.stddev_pop("real")
    return pairs.groupBy(*by, "target_gene").agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"),
        F.when(~flat, F.try_divide(F.covar_pop("pred", "real"), spread)).alias("pearson_delta"),
    )


def _vectors(deltas: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    entry = F.sort_array(F.collect_list(F.struct("gene_pos", "delta")))
    return deltas.groupBy(*by, "target_gene").agg(entry.alias("_e")).select(
        *by, "target_gene", F.col("_e.delta").alias(out)
    )


def _distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "l1":
        return np.stack([np.abs(b - row).sum(axis=1) for row in a])
    norms = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    dots = a @ b.T
    return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _place(vectors: np.ndarray, pivot: np.ndarray | None, kind: str) -> np.ndarray:
    """Distance of each vector to the pivot: the L1 norm, or the angle to ``pivot``; NaN for a vector without direction."""
    if kind == "l1":
        return np.abs(vectors).sum(axis=1)
    norms, length = np.linalg.norm(vectors, axis=1), np.linalg.norm(pivot)
    cosine = np.divide(vectors @ pivot, norms * length, out=np.zeros(len(vectors)), where=norms * length > 0)
    return np.where(norms > 0, np.arccos(np.clip(cosine, -1.0, 1.0)), np.nan)


def _placed(rows: DataFrame, real: DataFrame, by: list[str], vector: str, kind: str, own: str | None) -> DataFrame:
    """``rows`` with ``at``, the place of their vector, and for ``own``, its distance ``d0`` to the label's own vector, which is dropped."""
    if kind == "cosine":
        mean = real.groupBy(*by, "gene_pos").agg(F.avg("delta").alias("delta")).withColumn("target_gene", F.lit(""))
        pivots = materialized(_vectors(mean, by, "_pivot").drop("target_gene"), "pivots")
        rows = rows.join(pivots, by) if by else rows.withColumn("_pivot", pivots.scalar())
    carried = [c for c in rows.columns if c not in ("_pivot", own)]
    types = dict(rows.dtypes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, len(pdf), BLOCK):
                part = pdf.iloc[first : first + BLOCK]
                out, vs = part[carried].copy(), np.stack(part[vector].to_numpy())
                out["at"] = [_place(vs[i : i + 1], part["_pivot"].iloc[i] if kind == "cosine" else None, kind)[0] for i in range(len(vs))]
                if own:
                    out["d0"] = [_distances(vs[i : i + 1], np.asarray(part[own].iloc[i])[None, :], kind)[0, 0] for i in range(len(vs))]
                yield out

    schema = ", ".join([f"`{c}` {types[c]}" for c in carried] + ["at double"] + ["d0 double"] * bool(own))
    return rows.mapInPandas(place, schema).withColumn("at", F.when(~F.isnan("at"), F.col("at")))


#: Distances are compared at nine decimals; a block is settled unread only beyond that.
MARGIN = 1e-7


def settled_blocks(left: DataFrame, kind: str) -> DataFrame:
    """``left`` (at, d0, blocks array<struct<rb, lo, hi, n>>) with ``read``, the blocks to be read, and ``closer``, the labels of blocks
    that are closer as a whole.

    By the triangle inequality a label at ``at`` is no nearer to a member of a block at lo to hi than the gap between
    them, and no farther than the sum of both. Vectors without direction (null places) are at cosine distance 1 of all.
    """
    at, d0 = F.col("at"), F.col("d0")

    def judged(b: Column) -> Column:
        gap = F.greatest(b["lo"] - at, at - b["hi"], F.lit(0.0))
        least, most = gap, at + b["hi"]
        if kind == "cosine":
            flat = at.isNull() | b["lo"].isNull()
            least = F.when(flat, F.lit(1.0)).otherwise(1 - F.cos(F.greatest(gap - MARGIN, F.lit(0.0))))
            most = F.when(flat, F.lit(1.0)).otherwise(1 - F.cos(F.least(most + MARGIN, F.lit(math.pi))))
            return F.when(flat, F.when(F.round(d0, 9) > 1, "all").otherwise("none")).when(least > d0 + MARGIN, "none").when(most < d0 - MARGIN, "all").otherwise("read")
        return F.when(least > d0 + MARGIN, "none").when(most < d0 - MARGIN, "all").otherwise("read")

    verdicts = F.transform("blocks", lambda b: F.struct(b["rb"].alias("rb"), b["n"].alias("n"), judged(b).alias("how")))
    whole = F.aggregate(F.filter(verdicts, lambda v: v["how"] == "all"), F.lit(0).cast("bigint"), lambda n, v: n + v["n"])
    return left.withColumns({"read": F.transform(F.filter(verdicts, lambda v: v["how"] == "read"), lambda v: v["rb"]), "closer": whole})


def discrimination(pred: DataFrame, real: DataFrame, kinds: Sequence[str] = ("l1",), by: Sequence[str] = ()) -> DataFrame:
    """by..., target_gene, kind, n_real, n_closer, score: 1 - (real labels closer than the own one) / n_real.

    The inputs are full (by..., target_gene, gene_pos, delta) grids. Real labels are cut into blocks of about 256 by
    their place: the norm for L1, the angle to the mean for cosine. The triangle inequality settles most blocks
    for a label unread; its vector goes only to the others, where a task returns how many labels are closer. Distances are
    compared at nine decimals. A vector without direction has cosine distance 1 to all.
    """
    if not kinds or set(kinds) - {"l1", "cosine"}:
        raise ValueError(f"unknown distances {list(kinds)!r}")
    parts = [_closer(pred, real, kind, list(by)).withColumn("kind", F.lit(kind)) for kind in kinds]
    ranks = reduce(DataFrame.unionByName, parts)
    n_real = real.select(*by, "target_gene").distinct().groupBy(*by).agg(F.count("*").alias("n_real"))
    ranks = ranks.join(n_real, list(by)) if by else ranks.withColumn("n_real", n_real.scalar())
    return ranks.select(*by, "target_gene", "n_real", "kind", "n_closer").withColumn("score", 1.0 - F.col("n_closer") / F.col("n_real"))


def block_pairs(pred: DataFrame, real: DataFrame, kind: str, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(left, right): predicted labels with what of the blocks must be read, and real labels with their block ``rb``."""
    by = list(by)
    r = _vectors(real, by, "rv")
    right = materialized(_placed(r.withColumnRenamed("target_gene", "other").withColumnRenamed("rv", "ov"), real, by, "ov", kind, None), "real-vectors")
    group = right.groupBy(*by)
    ends = group.agg((F.ceil(F.count("*") / BLOCK)).alias("_n"), F.percentile_approx("at", [k / 64 for k in range(1, 64)], 10_000).alias("_q"))
    # few blocks take some of the 63 bounds, more are cut again by hash: a bound on places serves all blocks between two bounds
    step = F.greatest(F.floor(64 / F.col("_n")), F.lit(1))
    ends = materialized(ends.select(*by, F.filter("_q", lambda x, i: (i + 1) % step == 0).alias("_ends"), F.greatest(F.ceil(F.col("_n") / 64), F.lit(1)).alias("_cuts")), "block-ends")
    right = right.join(ends, by) if by else right.withColumn("_both", ends.select(F.struct("_ends", "_cuts")).scalar()).select("*", "_both.*").drop("_both")
    band = F.size(F.filter("_ends", lambda e: e < F.col("at")))
    place = F.when(F.col("at").isNull(), F.lit(-1)).otherwise(band * F.col("_cuts") + F.pmod(F.xxhash64("other"), F.col("_cuts")))
    right = right.withColumn("rb", place.cast("bigint")).drop("_ends", "_cuts")
    stats = right.groupBy(*by, "rb").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    blocks = materialized(stats.groupBy(*by).agg(F.collect_list(F.struct("rb", "lo", "hi", "n")).alias("blocks")), "blocks")
    left = _placed(_vectors(pred, by, "pv").join(r, [*by, "target_gene"]), real, by, "pv", kind, "rv")
    left = left.join(blocks, by) if by else left.withColumn("blocks", blocks.scalar())
    return settled_blocks(left, kind).drop("blocks"), right


def _closer(pred: DataFrame, real: DataFrame, kind: str, by: list[str]) -> DataFrame:
    """by..., target_gene, n_closer."""
    left, right = block_pairs(pred, real, kind, by)
    left = materialized(left, "settled")
    width = right.select("rb").distinct().agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    read = left.select(*by, "target_gene", "pv", "d0", F.explode("read").alias("rb"), F.pmod(F.xxhash64("target_gene"), width).alias("pb"))
    # a block is read by as many tasks as there are groups of labels that need it
    pairs = materialized(read.groupBy(*by, "rb").agg(F.collect_set("pb").alias("_pbs")), "block-readers")
    theirs = right.join(pairs, [*by, "rb"]).select(*by, "other", "ov", "rb", F.explode("_pbs").alias("pb"))

    def count_closer(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if lhs.empty or rhs.empty:
            return pd.DataFrame({c: [] for c in [*by, "target_gene", "n_closer"]})
        a, b = (np.stack(x.to_numpy()) for x in (lhs.pv, rhs.ov))
        others = lhs.target_gene.to_numpy()[:, None] != rhs.other.to_numpy()[None, :]
        closer = np.round(_distances(a, b, kind), 9) < np.round(lhs.d0.to_numpy(), 9)[:, None]
        return lhs[[*by, "target_gene"]].assign(n_closer=(closer & others).sum(axis=1))

    types = dict(left.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["target_gene string", "n_closer bigint"])
    keys = [*by, "pb", "rb"]
    counted = read.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(count_closer, schema)
    every = counted.unionByName(left.select(*by, "target_gene", F.col("closer").alias("n_closer")))
    return every.groupBy(*by, "target_gene").agg(F.sum("n_closer").alias("n_closer"))


def significance_pairs(pred: DataFrame, real: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """by..., target_gene, gene, z_p, z_r, sig_p, sig_r, rank_p, rank_r from two test tables."""
    keys = [*by, "target_gene", "gene"]
    both = pred.select(*keys, F.col("z").alias("z_p")).join(real.select(*keys, F.col("z").alias("z_r")), keys)

    def rank(z: str):
        return F.row_number().over(W.partitionBy(*by, "target_gene").orderBy(F.desc(F.round(F.abs(z), 9)), "gene"))

    return both.select(
        *keys, "z_p", "z_r", (F.abs("z_p") > threshold).alias("sig_p"), (F.abs("z_r") > threshold).alias("sig_r"),
        rank("z_p").alias("rank_p"), rank("z_r").alias("rank_r"),
    )


def overlap_at(pairs: DataFrame, sig: str) -> DataFrame:
    """target_gene, n, n_shared, value: shared genes of both top-N lists over N = significant genes on side ``sig``."""
    n = pairs.withColumn("n", F.count_if(F.col(sig)).over(W.partitionBy("target_gene")))
    shared = F.count_if((F.col("rank_p") <= F.col("n")) & (F.col("rank_r") <= F.col("n")))
    out = n.groupBy("target_gene").agg(F.max("n").alias("n"), shared.alias("n_shared"))
    return out.withColumn("value", F.when(F.col("n") > 0, F.col("n_shared") / F.col("n")))


def n_significant(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("target_gene").agg(
        F.count_if(F.col("sig_p")).alias("nsig_pred"), F.count_if(F.col("sig_r")).alias("nsig_real")
    )


def significance_jaccard(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """|both| / |either|; NULL when no gene is significant on either side."""
    both, either = F.count_if(F.col("sig_p") & F.col("sig_r")), F.count_if(F.col("sig_p") | F.col("sig_r"))
    return pairs.groupBy(*by, "target_gene").agg(both.alias("both"), either.alias("either")).withColumn(
        "value", F.when(F.col("either") > 0, F.col("both") / F.col("either"))
    )


def direction_agreement(pairs: DataFrame, by: Sequence[str] = (), sig: str = "sig_r") -> DataFrame:
    """Share of the significant genes (the real ones, or of side ``sig``) whose predicted and real sign are the same."""
    same = F.count_if(F.col(sig) & (F.signum("z_p") == F.signum("z_r")))
    return pairs.groupBy(*by, "target_gene").agg(same.alias("same"), F.count_if(F.col(sig)).alias("n")).withColumn(
        "value", F.when(F.col("n") > 0, F.col("same") / F.col("n"))
    )


def fold_change_error(pairs: DataFrame, pred_lfc: DataFrame, real_lfc: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """sum |lfc_p - lfc_r| / sum |lfc_r| over the real significant genes."""
    keys = [*by, "target_gene", "gene"]
    rows = (
        pairs.filter("sig_r").select(*keys)
        .join(pred_lfc.select(*keys, F.col("log2fc").alias("lfc_p")), keys)
        .join(real_lfc.select(*keys, F.col("log2fc").alias("lfc_r")), keys)
    )
    agg = rows.groupBy(*by, "target_gene").agg(
        F.sum(F.abs(F.col("lfc_p") - F.col("lfc_r"))).alias("err"), F.sum(F.abs("lfc_r")).alias("size")
    )
    return agg.withColumn("value", F.when(F.col("size") > 0, F.col("err") / F.col("size")))


def mean_gene_variance(entries: DataFrame, cells: DataFrame, genes: DataFrame, control: str = CONTROL) -> DataFrame:
    """One row: mean over genes of the population variance over non-control cells."""
    pert = F.col("target_gene") != control
    n = cells.filter(pert).agg(F.count("*").alias("n")).scalar()
    sums = entries.filter(pert).groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    full = genes.select("gene").join(sums, "gene", "left").fillna(0.0, ["s", "ss"]).withColumn("n", n)
    return full.agg(F.avg(pop_var(F.col("ss"), F.col("s"), F.col("n"))).alias("mean_var"))


def variance_inflation(pred_var: DataFrame, real_var: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """One row: variance_ratio (infinite when the real variance is 0) and flagged (strictly over tolerance)."""
    row = real_var.select(F.col("mean_var").alias("real")).withColumn("pred", pred_var.select("mean_var").scalar())
    ratio = F.when(F.col("real") > 0, F.col("pred") / F.col("real")).otherwise(F.lit(float("inf")))
    return row.select(ratio.alias("variance_ratio")).withColumn("flagged", F.col("variance_ratio") > tolerance)


def metric_means(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by..., metric, value: mean over labels, NULLs skipped."""
    return scores.groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def scale_to_anchors(user: DataFrame, base: DataFrame, replicate: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(u - b) / (r - b) per key and metric: 0 is the generic response, 1 a replicate.

    The squared error is clamped to [0, 1], the fold-change error floored at -6. Anchors that agree
    to nine places span no scale: NULL.
    """
    keys = [*keys, "metric"]
    rows = (
        user.select(*keys, F.col("value").alias("u"))
        .join(base.select(*keys, F.col("value").alias("b")), keys)
        .join(replicate.select(*keys, F.col("value").alias("r")), keys)
    )
    span = F.col("r") - F.col("b")
    raw = F.when(F.abs(span) > 1e-9, (F.col("u") - F.col("b")) / span)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    floored = F.greatest(F.lit(-6.0), raw)
    return rows.withColumn(
        "scaled", F.when(F.col("metric") == "mse", clamped).when(F.col("metric") == "lfc_nmae", floored).otherwise(raw)
    )


def overall(scaled: DataFrame) -> DataFrame:
    """One row: unweighted mean over all metric x key members."""
    return scaled.agg(F.avg("scaled").alias("overall"), F.count("scaled").alias("n_members"))


def generalization_gap(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """metric, gap = train - holdout; NULL when the holdout lacks the metric."""
    return train.select("metric", F.col("value").alias("t")).join(
        holdout.select("metric", F.col("value").alias("h")), "metric", "left"
    ).select("metric", (F.col("t") - F.col("h")).alias("gap"))


def ladder_ranks(scores: DataFrame) -> DataFrame:
    """model, metric, value, rank: best first in the metric's own direction."""
    lower = [m for m, up in HIGHER_IS_BETTER.items() if not up]
    key = F.when(F.col("metric").isin(lower), F.col("value")).otherwise(-F.col("value"))
    return scores.withColumn("rank", F.rank().over(W.partitionBy("metric").orderBy(F.round(key, 9).asc_nulls_last())))


def ladder_report(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model: a column per metric and the average rank over metrics."""
    ranks = ladder_ranks(scores).groupBy("model").agg(F.avg("rank").alias("avg_rank"))
    wide = scores.groupBy("model").pivot("metric", check_metric_names(metrics)).agg(F.first("value"))
    return wide.join(ranks, "model")


def private_gain_guard(public: DataFrame, private: DataFrame, baseline: str) -> DataFrame:
    """model, metric, gain_public, gain_private, blocked: better than the baseline only on the public split."""
    lower = [m for m, up in HIGHER_IS_BETTER.items() if not up]
    sign = F.when(F.col("metric").isin(lower), F.lit(-1.0)).otherwise(F.lit(1.0))

    def gains(scores: DataFrame, out: str) -> DataFrame:
        base = scores.filter(F.col("model") == baseline).select("metric", F.col("value").alias("_base"))
        return scores.filter(F.col("model") != baseline).join(base, "metric").select(
            "model", "metric", (sign * (F.col("value") - F.col("_base"))).alias(out)
        )

    both = gains(public, "gain_public").join(gains(private, "gain_private"), ["model", "metric"])
    return both.withColumn("blocked", (F.col("gain_public") > 0) & (F.col("gain_private") <= 0))


def e_distance(vectors: DataFrame, group: str, values: str, reference: object) -> DataFrame:
    """group, n, e_distance against the reference group: 2 E|X-Y|^2 - E|X-X'|^2 - E|Y-Y'|^2.

    Squared Euclidean distances with the within-group means over distinct pairs. They need only
    each group's first two moments, so the cost is one aggregation instead of all cell pairs.
    """
    long = vectors.select(F.col(group).alias("g"), F.posexplode(values).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    moments = long.groupBy("g", "pos").agg(
        F.count("*").alias("n"), F.avg("v").alias("m"), F.avg(F.col("v") * F.col("v")).alias("q")
    )
    ref = moments.filter(F.col("g") == reference).select(
        "pos", F.col("n").alias("n0"), F.col("m").alias("m0"), F.col("q").alias("q0")
    )
    c = F.col

    def within(n: str, m: str, q: str):
        return 2.0 * (c(q) - c(m) * c(m)) * c(n) / F.greatest(c(n) - 1, F.lit(1))

    between = c("q") + c("q0") - 2.0 * c("m") * c("m0")
    part = 2.0 * between - within("n", "m", "q") - within("n0", "m0", "q0")
    return (
        moments.filter(c("g") != reference).join(ref, "pos").groupBy(c("g").alias(group))
        .agg(F.max("n").alias("n"), F.sum(part).alias("e_distance"))
    )
