"""What grows with the cells is dealt over tasks by its own size, and never taken for a small table."""

import re

import numpy as np

from pertmatrix.matrix import CONTROL
from pertmatrix.operators import emit, predictors as R, pseudobulk as P, sampling as S
from pertmatrix.plans import QUERIES, cell_scores as CS, q_models as QM
from pertmatrix.sources import testdata as T
from pyspark.sql import functions as F


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_long_range_is_expanded_by_several_tasks(spark):
    one = spark.createDataFrame([("a", 200_000)], "target_gene string, n bigint")
    ranged = S.explode_range(one, "n", "i").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("k")).collect()
    assert len(ranged) > 1 and sum(r.k for r in ranged) == 200_000


def test_draws_are_not_broadcast(spark, make_matrix):
    """They come from a few chunks, whose size is all that adaptive execution sees."""
    m = make_matrix(np.ones((60, 2)), [CONTROL] * 30 + ["a"] * 30)
    boot = executed(P.bootstrap_profiles(m.expr, m.cells, m.genes, ["target_gene"], 3))
    assert not re.search(r"BroadcastHashJoin \[(target_gene#\d+, pool_idx|cell_id#\d+L?\], \[cell_id)", boot)
    requests = spark.createDataFrame([("a", 30)], "target_gene string, n bigint")
    drawn = executed(R.predict_cells(requests, R.zero_delta(requests, m.genes), m.expr.join(m.cells, "cell_id"), m.cells, m.genes))
    assert re.search(r"SortMergeJoin \[pool_idx", drawn) and not re.search(r"BroadcastHashJoin \[pool_idx", drawn)


def test_entries_are_dealt_by_cell_over_tasks_by_their_number(spark, monkeypatch):
    """Partitions are not joined by their compressed bytes, and a check by cell does not shuffle them again."""
    monkeypatch.setattr(T, "LINES_A_TASK", 300)
    sf = "/root/testdata/sf0.001"
    tasks = T.cell_tasks(spark, sf)
    assert tasks == -(-T.table(spark, sf, "lineitem").count() // 300) > spark.sparkContext.defaultParallelism
    m = T.count_matrix(spark, sf)
    assert m.expr.select(F.spark_partition_id()).distinct().count() == tasks
    assert m.rows.filter("libsize > 0").select(F.spark_partition_id()).distinct().count() == tasks
    text = QUERIES["validate_block_values"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(cell_id#\d+L?, \d+\), REPARTITION_BY", text)) == 1


def test_even_cells_are_the_even_allocation_without_a_shuffle_by_cell(spark):
    rng = np.random.default_rng(3)
    rows = [("A", lab, j, f"g{j}", n, int(t), int(t) // n, int(t) % n) for lab, n in (("p", 1), ("q", 97), ("r", 5000)) for j, t in enumerate(rng.integers(0, 3 * n + 2, 12))]
    totals = spark.createDataFrame(rows, "context string, target_gene string, gene_pos bigint, gene string, n bigint, total bigint, base bigint, rem bigint")
    keys = ["context", "target_gene", "cell_no"]
    want = emit.allocate_even(totals, seed=4).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("entries"), F.sum("value").alias("libsize"))
    got = emit.even_cells(totals, seed=4)
    filled = got.filter("libsize > 0").select(*keys, "entries", "libsize")
    assert got.count() == 5098 and sorted(filled.collect()) == sorted(want.collect())
    assert not re.search(r"hashpartitioning\([^)]*cell_no", executed(got))


def test_a_ladder_of_cells_packs_the_lines_once(spark):
    """Every pass over the groups reads written rows; none sums and packs the lines anew."""
    sf = "/root/testdata/sf0.001"
    groups = CS.ladder_groups(T.count_matrix(spark, sf), QM.MODELS, QM.HELD_OUT)
    read = groups.entries.inputFiles()
    assert read and not [f for f in read if "lineitem" in f]


def test_profiles_of_the_controls_pack_the_lines_once(spark):
    for name in ("allocate_even", "context_profile", "shift_fraction"):
        read = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and not [f for f in read if "lineitem" in f], name


def test_many_parts_meet_the_lines_without_a_sort(spark, monkeypatch):
    """A sort of the lines by part has as many of them as adaptive execution joins into a task, by their compressed bytes."""
    sf = "/root/testdata/sf0.001"
    want = sorted(T.expr(spark, sf).collect()), sorted(T.edges(spark, sf).collect())
    monkeypatch.setattr(T, "FEW_PARTS", 10)
    for made, rows in zip((T.expr(spark, sf), T.edges(spark, sf)), want):
        plan = executed(made)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
        assert sorted(made.collect()) == rows


def test_queries_that_pass_over_the_entries_twice_pack_the_lines_once(spark):
    for name in ("normalize_log1p", "pb_merge"):
        read = QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert read and not [f for f in read if "lineitem" in f], name
