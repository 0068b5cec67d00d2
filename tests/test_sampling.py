import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from pertmatrix.functions.hashing import seed_hash
from pertmatrix.operators import ranking, sampling as S


@pytest.fixture(scope="module")
def cells(spark):
    sizes = {"non-targeting": 3000, "A": 60, "B": 31, "C": 29, "D": 5}
    rows = [(lab, i) for lab, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, lab) for k, (lab, _) in enumerate(rows)], "cell_id bigint, target_gene string")


def counts(df):
    return {r.target_gene: r.n_cells for r in S.count_labels(df).collect()}


@pytest.mark.parametrize("keys", [["target_gene"], []])
def test_bucketed_rank_is_the_plain_rank(cells, keys):
    h = seed_hash(3, "cell_id")
    ranked = ranking.shuffled_row_number(cells, keys, h, "cell_id")
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(h, "cell_id")
    assert ranked.withColumn("plain", F.row_number().over(w)).filter("plain != rank").count() == 0
    assert ranked.count() == 3125
    top = ranking.shuffled_row_number(cells, keys, h, "cell_id", at_most=F.lit(40))
    assert {(r.cell_id, r["rank"]) for r in top.collect()} == {(r.cell_id, r["rank"]) for r in ranked.filter("rank <= 40").collect()}


def test_caps_are_exact_and_seeded(cells):
    one = S.cap_per_label(cells, 30, 500, seed=1)
    assert counts(one) == {"non-targeting": 500, "A": 30, "B": 30, "C": 29, "D": 5}
    ids = {r.cell_id for r in one.collect()}
    assert ids == {r.cell_id for r in S.cap_per_label(cells.repartition(3), 30, 500, seed=1).collect()}
    assert ids != {r.cell_id for r in S.cap_per_label(cells, 30, 500, seed=2).collect()}
    assert counts(S.cap_control(cells, 8000)) == counts(cells)
    assert S.cap_cells(cells, 777).count() == 777


def test_keep_list_always_keeps_the_control(spark, cells):
    keep = spark.createDataFrame([("A",)], "label string")
    assert counts(S.cap_per_label(cells, None, 10, keep=keep)) == {"A": 60, "non-targeting": 10}


def test_holdout_is_deterministic_whole_labels_and_clamped(cells):
    sides = {r.target_gene: r.side for r in S.carve_holdout(cells, 1, seed=4).collect()}
    assert sides == {r.target_gene: r.side for r in S.carve_holdout(cells, 1, seed=4).collect()}
    assert sorted(sides.values()) == ["holdout", "train", "train", "train"] and sides["C"] == sides["D"] == "train"
    every = {r.target_gene: r.side for r in S.carve_holdout(cells, 99).collect()}
    assert {k for k, v in every.items() if v == "holdout"} == {"A", "B"}


def test_controls_are_on_both_sides(cells):
    sides = S.carve_holdout(cells, 99)
    assert counts(S.split_cells(cells, sides, "holdout")) == {"A": 60, "B": 31, "non-targeting": 3000}
    assert counts(S.split_cells(cells, sides, "train")) == {"C": 29, "D": 5, "non-targeting": 3000}
    with pytest.raises(ValueError):
        S.split_cells(cells, sides, "test")


def test_explode_range_over_several_chunks(spark):
    df = spark.createDataFrame([("a", 10_000), ("b", 0), ("c", 1)], "k string, n bigint")
    rows = S.explode_range(df, "n", "i", chunk=1000).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d"), F.max("i").alias("m"))
    assert {r.k: (r.n, r.d, r.m) for r in rows.collect()} == {"a": (10_000, 10_000, 9_999), "c": (1, 1, 0)}


def test_draws_are_uniform(spark):
    req = spark.createDataFrame([("p", 20_000, 10)], "target_gene string, n bigint, size bigint")
    hits = S.draw_with_replacement(req, "n", F.col("size"), ["target_gene"]).groupBy("pool_idx").count().toPandas()
    assert sorted(hits.pool_idx) == list(range(10))
    assert np.abs(hits["count"] - 2000).max() < 5 * np.sqrt(1800)


def test_running_total_and_first_per_group(spark):
    rng = np.random.default_rng(1)
    values = sorted(set(np.round(rng.normal(size=300) * 50, 3)))
    df = spark.createDataFrame([("k", float(v), i + 1) for i, v in enumerate(values)], "k string, v double, n bigint")
    got = {r.v: r.before for r in ranking.running_total(df, ["k"], "v", "n").collect()}
    assert [got[v] for v in values] == list(np.cumsum([0, *range(1, len(values))]))
    top = ranking.first_per_group(df, ["k"], [F.desc("v")], 3).orderBy("rank_in_group").collect()
    assert [r.v for r in top] == values[::-1][:3]
