"""What must not pass silently: flawed outputs, gene lists in several files, long axes, workers without the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pertmatrix import matrix
from pertmatrix.operators import cells as C, contract as K, edges, ranking
from pertmatrix.sources import scans

ROOT = Path(__file__).resolve().parents[1]


def found(violations):
    return {r.rule: r.n for r in violations.collect()}


def test_contract_sees_missing_doubled_and_homeless_entries(spark):
    genes = spark.createDataFrame([(0, "g0"), (1, "g1")], "gene_pos bigint, gene string")
    perts = spark.createDataFrame([("p",), ("q",)], "target_gene string")
    cells = spark.createDataFrame([(1, "A", "p"), (2, "A", "q"), (2, "A", "q")], "cell_id bigint, context string, target_gene string")
    rows = [(1, "g0", None), (1, "g1", 2.0), (1, "g1", 2.0), (1, "gx", 1.0), (9, "g0", 1.0), (9, "g1", 0.0), (2, "g0", 3.0)]
    entries = spark.createDataFrame(rows, "cell_id bigint, gene string, value double")
    contract = K.Contract(genes, perts, ("A",), cells_per_pert=1)
    assert found(K.value_violations(contract, cells, entries)) == {"missing values": 1, "doubled entries": 1, "entries without a cell": 1, "gene not on the axis": 1}
    assert found(K.completeness_violations(contract, cells)) == {"wrong count block": 1, "doubled cell": 1}


def test_gene_list_in_several_files_keeps_its_order(spark, tmp_path):
    (tmp_path / "part-0.csv").write_text("gene\nA\nB\n")
    (tmp_path / "part-1.csv").write_text("C\nD\nE\nF\nG\nH\nI\n")
    axis, header = scans.scan_gene_axis(spark, str(tmp_path), 9)
    assert header and [r.gene for r in axis.orderBy("gene_pos").collect()] == list("ABCDEFGHI")


def test_too_long_axis_is_refused_without_being_gathered(spark, monkeypatch):
    monkeypatch.setattr(matrix, "MAX_AXIS", 5)
    long = spark.range(1000).select(F.col("id").alias("gene_pos"), F.col("id").cast("string").alias("gene"))
    lookup = matrix.axis_lookup(long)
    assert "GlobalLimit 6" in lookup._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="longer than 5"):
        lookup.collect()


def test_feature_blocks_of_another_width_are_refused(spark):
    index = spark.createDataFrame([(0,), (1,)], "gene_pos bigint")
    block = spark.createDataFrame([(1, [1.0, 2.0])], "gene_pos bigint, features array<double>")
    assert {r.gene_pos: r.features for r in edges.concat_features(index, [(block, 2)]).collect()} == {0: [0.0, 0.0], 1: [1.0, 2.0]}
    with pytest.raises(Exception, match="declares 3 features"):
        edges.concat_features(index, [(block, 3)]).collect()


def test_value_buckets_tell_fractions_apart_and_never_fall(spark):
    values = [-1e300, -2.0, -0.02, -1e-6, 0.0, 5e-324, 1e-6, 1e-3, 0.01, 0.02, 1.0, 1.5, 2.0, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(ranking.value_bucket(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_label_filter_stands_below_every_exchange(spark, make_matrix):
    m = make_matrix([[1, 0], [2, 3], [0, 4]], ["a", "b", "a"])
    plan = C.labelled(m).filter("target_gene = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join") < plan.rindex("Filter") and plan.rindex("target_gene") > plan.index("Join")


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables are not here")
def test_workers_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pertmatrix.plans import QUERIES
from pertmatrix.operators.manifest import found_files
from pertmatrix.session import local_session
spark = local_session(2, "outside")
(open({str(tmp_path / "f.txt")!r}, "w")).write("x")
assert found_files(spark, {str(tmp_path)!r}).count() == 1
assert QUERIES["metric_pds_l1"](spark, "/root/testdata/sf0.001").count() > 0
assert QUERIES["de_bh_fdr"](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-1500:]
