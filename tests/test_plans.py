"""The shape of the physical plans: what reaches the scan, and which operators must not appear."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def plan(spark, name):
    return entry_points.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cell_libsize", "normalize_log1p", "context_profile", "rank_cap", "apply_delta_cells", "validate_block_values"])
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin|BatchEvalPython", plan(spark, name))


def test_only_used_columns_are_read(spark):
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "cell_cpm")))
    assert schemas == {"l_orderkey:bigint,l_partkey:bigint,l_quantity:double", "p_partkey:bigint,p_brand:string"}


def test_filters_reach_the_scan(spark):
    text = plan(spark, "filter_control_exact")
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert re.search(r"DataFilters: \[[^\]]*o_custkey", text)


def test_sums_are_partial_before_the_shuffle(spark):
    text = plan(spark, "cell_libsize")
    assert text.count("partial_sum") >= 2


def test_ranks_order_buckets_not_labels(spark):
    windows = re.findall(r"\+- Window (.*)", plan(spark, "rank_cap"))
    by_cell = [w for w in windows if "row_number" in w]
    assert by_cell and all("_bucket" in w for w in by_cell)


@pytest.mark.parametrize("name", ["scan_split", "sample_cap_per_label", "pb_median", "de_wilcoxon"])
def test_hot_labels_meet_written_lists(spark, name):
    """Cells and counted values are not shuffled by label, whatever small threshold a list still fits."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        text = plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[target_gene#\d+\], \[target_gene#\d+\], (LeftSemi|LeftAnti)", text)
    assert not re.search(r"SortMergeJoin \[target_gene#\d+, _bucket#\d+\]", text)
