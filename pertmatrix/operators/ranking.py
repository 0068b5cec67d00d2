"""Ranks and running totals that never put a whole group into one task.

A window over a hot label (the controls may be a third of all cells) would sort that label in a
single task. Both helpers cut every group into ordered buckets first: bucket totals give each
bucket its offset, and only the rows of one bucket are ever ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pertmatrix.session import materialized

_BUCKET_DIGITS = 3  # md5 is uniform, so 4096 buckets of equal expected size


def _offsets(sizes: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Per bucket, the total of all earlier buckets of its group (bounded: buckets, not rows)."""
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_offset", F.coalesce(F.sum(amount).over(before), F.lit(0)))


def shuffled_row_number(
    df: DataFrame, keys: Sequence[str], hash_hex: Column, tie: str, *, at_most: Column | None = None,
    out: str = "rank",
) -> DataFrame:
    """row_number() over (partition by keys order by hash, tie), exact, as a bigint from 1.

    ``at_most`` (over the keys) keeps only ranks up to that number; buckets that start beyond it
    are dropped before any row of theirs is shuffled for ordering. The buckets left, at most 4096 a key, are
    written first, so that Spark knows their size when it chooses the join.
    """
    whole = not keys
    keys = list(keys) or ["_all"]
    rows = df.withColumn("_hash", hash_hex)
    if whole:
        rows = rows.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
    sizes = _offsets(rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")), keys, "_n")
    if at_most is not None:
        sizes = sizes.withColumn("_cap", at_most).filter("_offset < _cap")
    sizes = sizes.drop("_n")
    if at_most is not None:
        sizes = materialized(sizes, "rank-buckets")
    inside = W.partitionBy(*keys, "_bucket").orderBy("_hash", tie)
    ranked = rows.join(sizes, [*keys, "_bucket"]).withColumn(
        out, (F.row_number().over(inside) + F.col("_offset")).cast("bigint")
    )
    if at_most is not None:
        ranked = ranked.filter(F.col(out) <= F.col("_cap"))
    return ranked.drop("_hash", "_bucket", "_offset", "_cap", "_all")


def value_bucket(value: Column) -> Column:
    """A bucket number that never falls as the value rises: 32 steps per doubling at every scale, fractions included."""
    step = F.floor(F.log2(F.abs(value)) * 32) + 40_000  # the smallest double is above 2 ** -1075
    return F.when(value == 0, 0).otherwise(F.signum(value) * step).cast("bigint")


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, amount: str, *, out: str = "before"
) -> DataFrame:
    """Total of ``amount`` over the rows with a smaller ``order`` value, per group.

    ``order`` must be distinct inside a group, as in a value histogram.
    """
    rows = df.withColumn("_bucket", value_bucket(F.col(order)))
    sizes = rows.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_amount"))
    offsets = _offsets(sizes, keys, "_amount").drop("_amount")
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.coalesce(F.sum(amount).over(inside), F.lit(0)) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = 64) -> DataFrame:
    """The first k rows per group with their rank. k is a small report size.

    Each group is cut by salt and every piece keeps its own first k, so the final ordering sees at
    most salts * k rows of a group however large the group is.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    piece = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(piece)).filter(F.col("_r") <= k).drop("_r", "_salt")
    return kept.withColumn("rank_in_group", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint")).filter(
        F.col("rank_in_group") <= k
    )


#: Equal parts that a value bucket with wanted ranks is cut into.
_PARTS = 4096


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], *, out: str = "q") -> DataFrame:
    """keys..., out: an array of the linear-interpolation quantiles ``qs`` of ``value``, exact for any group and any values.

    Selection instead of a sort or a buffer of all values: rows are counted by value bucket, then, in the buckets that
    hold a wanted rank, by 4096 equal parts between the bucket's ends; only values of the parts that hold one are
    ordered, equal ones as one row. Nulls are left out; a group without values has no row.
    """
    whole = not keys
    by = list(keys) or ["_all"]
    rows = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    if whole:
        rows = rows.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_bucket", value_bucket(F.col("_v")))
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    total = sizes.withColumn("_total", F.sum("_n").over(W.partitionBy(*by)))
    positions = F.array(*[F.lit(float(q)) * (F.col("_total") - 1) for q in qs])
    ranks = F.array_distinct(F.concat(F.transform(positions, lambda p: F.floor(p)), F.transform(positions, lambda p: F.ceil(p))))

    def holding(parts: DataFrame) -> DataFrame:
        inside = F.filter("_ranks", lambda r: (r >= F.col("_offset")) & (r < F.col("_offset") + F.col("_n")))
        return parts.withColumn("_ranks", inside).filter("size(_ranks) > 0")

    buckets = materialized(holding(_offsets(total.withColumn("_ranks", ranks), by, "_n")).withColumnRenamed("_offset", "_base").drop("_n"), "quantile-buckets")
    near = rows.join(buckets, [*by, "_bucket"])
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _PARTS)).otherwise(F.lit(0))
    near = near.withColumn("_part", part.cast("bigint"))
    cut = near.groupBy(*by, "_bucket", "_part").agg(F.count("*").alias("_n"), F.first("_base").alias("_base"), F.first("_ranks").alias("_ranks"))
    before = W.partitionBy(*by, "_bucket").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = holding(cut.withColumn("_offset", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0))))
    parts = materialized(parts.select(*by, "_bucket", "_part", "_offset", F.col("_ranks").alias("_wanted")), "quantile-parts")
    values = near.drop("_ranks").join(parts, [*by, "_bucket", "_part"]).groupBy(*by, "_bucket", "_part", "_v").agg(
        F.count("*").alias("_n"), F.first("_offset").alias("_offset"), F.first("_wanted").alias("_wanted")
    )
    earlier = W.partitionBy(*by, "_bucket", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = values.withColumn("_at", F.col("_offset") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    hits = placed.select(*by, "_v", F.explode(F.filter("_wanted", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_n")))).alias("_rank"))
    found = hits.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
    totals = buckets.groupBy(*by).agg(F.max("_total").alias("_total"))

    def at(q: float) -> Column:
        position = F.lit(float(q)) * (F.col("_total") - 1)
        low, high = (F.element_at("_m", f(position)) for f in (F.floor, F.ceil))
        return low + (high - low) * (position - F.floor(position))

    return found.join(totals, by).select(*keys, F.array(*[at(q) for q in qs]).alias(out))
