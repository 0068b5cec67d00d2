"""Exact top-k search in binary codes by incremental multi-index hashing.

Codes are cut into m segments, each an index of its own. Two codes at distance d agree in some segment up to
d // m bits, so after all segments were searched to radius r every code within m * (r + 1) - 1 has been seen. The
radius grows until the distance of the k-th verified code is within that. Probes carry the k-th distance so far,
and a pair is taken from the first segment in which it appears only, so no candidate is verified twice.

Rows with the same code share one entry with the k + 1 smallest ids, as no others can be among the k nearest.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from pertmatrix.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

BITS = 64


def sign_code(vector: Column) -> Column:
    """64 sign bits of a vector of up to 64 numbers, bit i set where number i is above 0; a null vector has no code."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    code = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit("a code has 64 bits"))).otherwise(code)


def segments(n_codes: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: about as many bits each as make a bucket hold a few codes."""
    m = min(16, math.ceil(BITS / max(4.0, math.log2(max(2, n_codes)) - 1)))
    cuts = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1))


def _probes(batches: Iterator[pa.RecordBatch], parts: list[tuple[int, int]], radius: int) -> Iterator[pa.RecordBatch]:
    from itertools import combinations

    import numpy as np

    flips = {w: np.array([sum(1 << b for b in c) for c in combinations(range(w), radius)], dtype=np.int64) for _, w in parts}
    for batch in batches:
        codes, bounds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        step = max(1, (1 << 18) // max(len(f) for f in flips.values()) if any(map(len, flips.values())) else 1)
        for at in range(0, len(codes), step):
            some, bound = codes[at : at + step], bounds[at : at + step]
            for no, (first, width) in enumerate(parts):
                masks = flips[width]
                own = (some.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some) * len(masks), no, np.int32)), pa.array((own[:, None] ^ masks).ravel()), pa.array(np.repeat(some, len(masks))), pa.array(np.repeat(bound, len(masks)))],
                    names=["segment", "value", "query", "bound"],
                )


def top_k(base: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """One row (query id, neighbour_id, distance, rank) for each of the ``k`` nearest rows of ``base`` to each query.

    Distance is the number of different bits; ties go to the smaller id. Rows with the query's own id are not
    its neighbours; other rows with its code are. Rows without id or code are neither searched nor found;
    repeated rows count once, and of an id with several codes the smallest counts. With fewer than ``k`` others,
    all are returned. Other columns are ignored.
    """
    rows = base.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).dropna().groupBy("id").agg(F.min("code").alias("code"))
    asked = materialized(queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("query")).dropna().groupBy("query_id").agg(F.min("query").alias("query")), "search-queries")
    first = F.row_number().over(Window.partitionBy("code", "_salt").orderBy("id"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", first).where(F.col("_n") <= k + 1)
    least = salted.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("_n") <= k + 1)
    codes = materialized(least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "search-codes")
    parts = segments(codes.count())
    at = F.explode(F.array(*[F.struct(F.lit(no).alias("segment"), _segment(F.col("code"), *p).alias("value")) for no, p in enumerate(parts)]))
    index = materialized(codes.select(at.alias("_s"), "code", F.get("ids", F.lit(0)).alias("first_id"), F.size("ids").alias("n_ids")).select("_s.*", "code", "first_id", "n_ids"), "search-index")

    pending = asked.select("query").distinct().withColumn("bound", F.lit(BITS))
    found = None
    finished = []
    for radius in range(max(w for _, w in parts) + 1):
        probes = pending.mapInArrow(lambda batches, r=radius: _probes(batches, parts, r), "segment int, value bigint, query bigint, bound int")
        differing = [F.bit_count(_segment(F.col("query").bitwiseXOR(F.col("code")), *p)) for p in parts]
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        # The first segment with the fewest differing bits is the one that finds the pair first.
        earliest = F.array_position(F.array(*differing), F.array_min(F.array(*differing))) - 1
        # the size of what Python makes is not known to the planner, so it must not choose to broadcast it
        near = probes.alias("p").hint("merge").join(
            index.alias("i"),
            (F.col("p.segment") == F.col("i.segment")) & (F.col("p.value") == F.col("i.value")) & (distance <= F.col("bound")) & (earliest == F.col("p.segment")) & (F.array_min(F.array(*differing)) == radius),
        ).select("query", "code", distance.alias("distance"), "first_id", "n_ids")
        pool = near if found is None else near.unionByName(found.join(pending.select("query"), "query", "left_semi"))
        ranked = pool.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "first_id"))).where(F.col("_n") <= k + 1).drop("_n")
        seen = F.sum("n_ids").over(Window.partitionBy("query").orderBy("distance", "first_id").rowsBetween(Window.unboundedPreceding, 0))
        found = materialized(ranked.withColumn("_seen", seen), "search-found")
        # k + 1 rows, as one of them may be the query itself
        kth = found.groupBy("query").agg(F.min(F.when(F.col("_seen") >= k + 1, F.col("distance"))).alias("_kth"))
        found = found.drop("_seen")
        state = materialized(pending.select("query").join(kth, "query", "left").select("query", F.coalesce("_kth", F.lit(BITS)).alias("bound")), "search-state")
        covered = len(parts) * (radius + 1) - 1
        done = state.where(F.col("bound") <= covered).select("query")
        finished.append(found.join(done, "query", "left_semi"))
        pending = state.where(F.col("bound") > covered)
        if pending.isEmpty():
            break
    nearest = finished[0]
    for more in finished[1:]:
        nearest = nearest.unionByName(more)
    near_ids = nearest.select("query", "code", "distance").join(codes, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    # the k + 1 best rows of a code's query suffice for every id that asks with it
    best = near_ids.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id"))).where(F.col("_n") <= k + 1).drop("_n")
    pairs = asked.join(best, "query").where(F.col("query_id") != F.col("neighbour_id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(id_col), "neighbour_id", F.col("distance").cast("int").alias("distance"), "rank")
