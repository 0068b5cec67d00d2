"""Packed rows and replicate vectors: the same results as from triples, and the plans they are for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertmatrix.matrix import CountMatrix, packed_cells
from pertmatrix.operators import cells as C, pseudobulk as P
from pertmatrix.session import scratch_path
from pertmatrix.sources import scans, sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pair(spark, make_matrix):
    """A matrix of triples, and the same one stored packed; cell 3 is empty."""
    rng = np.random.default_rng(5)
    X = rng.poisson(0.7, (60, 9))
    X[3] = 0
    m = make_matrix(X, ["ctrl" if i % 3 == 0 else "AB"[i % 2] for i in range(60)], contexts=["u" if i < 30 else "v" for i in range(60)])
    return m, scans.scan_packed(spark, sinks.write_packed(m, scratch_path(spark, "packed")))


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_packed_equals_triples(pair):
    m, p = pair
    same(m.cells, p.cells)
    same(m.expr, p.expr)
    same(C.cell_libsize(m), C.cell_libsize(p))
    same(C.labelled(m), C.labelled(p))
    for by in (("target_gene",), ("context", "target_gene")):
        a, b = P.label_sums(m, by=by, save=True), P.label_sums(p, by=by, save=True)
        same(a.label, b.label)
        got, want = ({(*[r[k] for k in by], r["gene"]): r for r in x.gene.collect()} for x in (b, a))
        assert got.keys() == want.keys()
        for key in want:
            for c in P.SUM_COLUMNS:
                assert got[key][c] == pytest.approx(want[key][c])


def test_core_pass_over_packed_rows_has_one_exchange_and_no_window(pair, spark):
    _, p = pair
    keep = spark.createDataFrame([("A",), ("ctrl",)], "label string")
    gene = P.label_sums(p, by=("context", "target_gene"), keep=keep).gene
    plan = plan_of(gene)
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(cell_id" not in plan
    assert "Join" not in plan.replace("BroadcastHashJoin", "")


def test_cells_of_a_packed_matrix_read_no_entries(pair):
    _, p = pair
    assert "entries" not in plan_of(p.cells).split("ReadSchema")[1]


def test_where_filters_cells_and_rows(pair):
    for m in pair:
        u = m.where("context = 'u'")
        assert u.cells.count() == 30
        got = {r["target_gene"]: r["n_cells"] for r in P.label_sums(u).label.collect()}
        assert sum(got.values()) == 30 - C.cell_libsize(u).filter("libsize = 0").count()


def test_an_empty_matrix_packs(spark, make_matrix):
    m = make_matrix(np.zeros((0, 2)), [])
    p = CountMatrix(m.cells, m.genes, m.expr, packed_cells(m.cells, m.expr))
    assert C.labelled(p).count() == P.label_sums(p).label.count() == 0


@pytest.mark.parametrize("replicates", [3, 70])
def test_replicate_vectors(pair, replicates):
    m, _ = pair
    draws = P.draw_vectors(m.cells, ["target_gene"], replicates, min_cells=5, seed=2).collect()
    sizes = {r["target_gene"]: r["n_cells"] for r in P.group_sizes(m.cells, ["target_gene"]).collect()}
    total = {}
    for r in draws:
        total[r["target_gene"]] = total.get(r["target_gene"], 0) + np.array(r["times"])
    assert all((total[g] == n).all() and len(total[g]) == replicates for g, n in sizes.items())
    values = {(r["cell_id"], r["gene"]): r["value"] for r in m.expr.collect()}
    want = {}
    for r in draws:
        for (cell, gene), v in values.items():
            if cell == r["cell_id"]:
                want[r["target_gene"], gene] = want.get((r["target_gene"], gene), 0) + v * np.array(r["times"])
    got = P.bootstrap_profiles(m.expr, m.cells, m.genes, ["target_gene"], replicates, min_cells=5, seed=2).collect()
    assert len(got) == 3 * 9 * replicates
    for r in got:
        assert r["value"] == (want[r["target_gene"], r["gene"]][r["replicate"]] if (r["target_gene"], r["gene"]) in want else 0)


def test_replicates_do_not_multiply_the_entries(pair):
    m, _ = pair
    plans = [P.bootstrap_profiles(m.expr, m.cells, m.genes, ["target_gene"], n, min_cells=5)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 8)]
    assert [p.count("Join") for p in plans][0] == [p.count("Join") for p in plans][1]
    assert all("replicate" not in line for p in plans for line in p.splitlines() if "Aggregate" in line and "gene" in line and "_r0" in line)
