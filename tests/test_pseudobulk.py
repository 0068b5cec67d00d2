import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from pertmatrix.matrix import CountMatrix, pack_rows, unpack_dense, unpack_rows
from pertmatrix.operators import axis, cells as C, pseudobulk as P
from pertmatrix.session import scratch_path
from pertmatrix.sources import sinks
from pertmatrix.streaming import incremental as I


@pytest.fixture(scope="module")
def toy(make_matrix):
    rng = np.random.default_rng(0)
    X = rng.poisson(1.5, size=(57, 11)).astype(float)
    X[3] = 0
    labels = rng.choice(["ctrl", "A", "B", "C"], size=57)
    labels[3] = "A"
    return X, labels, make_matrix(X, labels)


def brute(X, labels, lab):
    rows = X[(labels == lab) & (X.sum(1) > 0)]
    cpm = rows / rows.sum(1, keepdims=True) * 1e6
    return rows, cpm


def check_sums(pb, X, labels, wanted):
    gene, label = table(pb.gene, "target_gene", "gene"), table(pb.label, "target_gene")
    assert set(label) == set(wanted)
    for lab in wanted:
        rows, cpm = brute(X, labels, lab)
        assert label[lab].n_cells == len(rows) and label[lab].libsize_sum == rows.sum()
        for j in range(X.shape[1]):
            r = gene.get((lab, f"g{j}"))
            got = (r.count_sum, r.cpm_sum, r.cpm_sq_sum) if r else (0, 0, 0)
            np.testing.assert_allclose(got, (rows[:, j].sum(), cpm[:, j].sum(), (cpm[:, j] ** 2).sum()), rtol=1e-12)


@pytest.mark.parametrize("save", [False, True])
def test_sums_equal_in_memory_sums(toy, save):
    X, labels, m = toy
    check_sums(P.label_sums(m, save=save), X, labels, ["ctrl", "A", "B", "C"])


def test_keep_and_skip_lists(spark, toy):
    X, labels, m = toy
    keep = spark.createDataFrame([("A",), ("ctrl",), ("absent",)], "label string")
    skip = spark.createDataFrame([("ctrl",)], "label string")
    check_sums(P.label_sums(m, keep=keep, skip=skip), X, labels, ["A"])


def test_a_label_with_only_empty_cells_stays(make_matrix):
    m = make_matrix([[0, 0], [1, 2]], ["E", "A"])
    assert table(P.label_sums(m).label, "target_gene")["E"].n_cells == 0


def test_merge_and_control_once(toy):
    X, labels, m = toy
    even = F.col("cell_id") % 2 == 0
    ctrl = F.col("target_gene") == "ctrl"
    files = m.cells.filter(even | ctrl).withColumn("source_ord", F.lit(0)).unionByName(
        m.cells.filter(~even | ctrl).withColumn("source_ord", F.lit(1))
    )
    once = P.control_once(files, control="ctrl")
    parts = [P.label_sums(CountMatrix(once.filter(F.col("source_ord") == i), m.genes, m.expr)) for i in (0, 1)]
    check_sums(P.merge(*parts), X, labels, ["ctrl", "A", "B", "C"])


def test_axes_must_agree_to_merge(spark, toy):
    _, _, m = toy
    axis.require_same_axis(m.genes, m.genes)
    with pytest.raises(ValueError, match="axes differ"):
        axis.require_same_axis(m.genes, m.genes.withColumn("gene_pos", 10 - F.col("gene_pos")))


def test_round_trip(spark, toy):
    X, labels, m = toy
    path = sinks.write_pseudobulk(P.label_sums(m), scratch_path(spark, "t"))
    check_sums(sinks.read_pseudobulk(spark, path), X, labels, ["ctrl", "A", "B", "C"])


def test_packed_and_dense_layouts(spark, toy):
    X, _, m = toy
    packed = pack_rows(m)
    assert {(r.cell_id, r.gene_pos): r.value for r in unpack_rows(packed).collect()} == {(i, j): X[i, j] for i, j in zip(*np.nonzero(X))}
    with pytest.raises(ValueError, match="sparse rows"):
        unpack_rows(packed.withColumnRenamed("idx", "columns"))
    dense = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id bigint, v array<double>")
    assert unpack_dense(dense, "id", "v").count() == (X != 0).sum()


def test_streams_equal_the_batch(spark, toy):
    X, labels, m = toy
    rows = pack_rows(m).join(m.cells.select("cell_id", "target_gene"), "cell_id").select("cell_id", "target_gene", "idx", "val", F.lit(0).alias("source_ord"))
    src = scratch_path(spark, "in")
    rows.repartition(4).write.parquet(src)
    again = rows.filter("target_gene = 'ctrl'").withColumn("source_ord", F.lit(1))
    again.write.mode("append").parquet(src)  # a second source repeats the controls
    want = {(r.target_gene, r.gene_pos): r.cpm_sq_sum for r in I.sums(I.packed_entries(rows)).collect()}
    got = I.run_running_sums(I.control_once(I.read_packed(spark, src), "ctrl"), scratch_path(spark, "o"), scratch_path(spark, "c"))
    got = {(r.target_gene, r.gene_pos): r.cpm_sq_sum for r in got.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 1e-12 for k in want)
    keep = spark.createDataFrame([("A",)], "k string")
    folded = I.run_folded_sums(I.keep_labels(I.read_packed(spark, src), keep), scratch_path(spark, "o"), scratch_path(spark, "c"))
    folded = {(r.target_gene, r.gene_pos): r.count_sum for r in folded.collect()}
    assert folded == {("A", j): X[labels == "A", j].sum() for j in range(11) if X[labels == "A", j].sum()}


@pytest.mark.parametrize("how", ["sum", "mean", "median"])
def test_profiles_count_zeros(toy, how):
    X, labels, m = toy
    got = table(P.group_profiles(C.labelled(m), m.cells, m.genes, ["target_gene"], how, min_cells=12), "target_gene", "gene")
    kept = [lab for lab in set(labels) if (labels == lab).sum() >= 12]
    assert {k[0] for k in got} == set(kept)
    for lab in kept:
        want = getattr(np, how)(X[labels == lab], axis=0)
        np.testing.assert_allclose([got[(lab, f"g{j}")].value for j in range(11)], want)


def test_profile_errors(toy):
    _, _, m = toy
    with pytest.raises(ValueError, match="unknown aggregate"):
        P.group_profiles(m.expr, m.cells, m.genes, ["target_gene"], "mode")
    with pytest.raises(KeyError):
        P.group_profiles(m.expr, m.cells, m.genes, ["donor"])
    with pytest.raises(ValueError, match="no groups"):
        P.require_rows(P.group_sizes(m.cells, ["target_gene"], 1000), "no groups")


def test_median_of_continuous_values(make_matrix):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(40, 3)) * (rng.random((40, 3)) < 0.7)
    m = make_matrix(X, ["A"] * 21 + ["B"] * 19)
    entries = m.expr.join(m.cells, "cell_id")
    got = table(P.group_profiles(entries, m.cells, m.genes, ["target_gene"], "median", 0), "target_gene", "gene")
    for lab, part in (("A", X[:21]), ("B", X[21:])):
        np.testing.assert_allclose([got[(lab, f"g{j}")].value for j in range(3)], np.median(part, axis=0))


def test_bootstrap_draws_n_cells_per_replicate(toy):
    X, labels, m = toy
    draws = P.bootstrap_draws(m.cells, ["target_gene"], 3, min_cells=1, seed=5)
    per = table(draws.groupBy("target_gene", "replicate").agg(F.sum("times").alias("n")), "target_gene", "replicate")
    assert {k: r.n for k, r in per.items()} == {(lab, i): (labels == lab).sum() for lab in set(labels) for i in range(3)}
    profiles = table(P.bootstrap_profiles(m.expr, m.cells, m.genes, ["target_gene"], 3, min_cells=1, seed=5), "target_gene", "replicate", "gene")
    for r in draws.filter("target_gene = 'B' and replicate = 2").groupBy().agg(F.collect_list(F.struct("cell_id", "times")).alias("d")).collect():
        want = sum(X[c.cell_id] * c.times for c in r.d)
        np.testing.assert_allclose([profiles[("B", 2, f"g{j}")].value for j in range(11)], want)


def test_control_profile_weighs_rows_equally(make_matrix):
    m = make_matrix([[2], [4], [12]], ["non-targeting"] * 2 + ["A"])
    cells = m.cells.withColumn("batch", F.when(F.col("cell_id") == 0, "x").otherwise("y"))
    entries = m.expr.join(cells, "cell_id")
    profiles = P.group_profiles(entries, cells, m.genes, ["target_gene", "batch"], "sum", 0)
    assert P.control_profile(profiles).first().control == 3
    assert P.delta_vs_control(profiles).first().delta == 9


def test_moments_match_float64(make_matrix):
    rng = np.random.default_rng(0)
    X = (rng.random((300, 6)) * 8).astype(np.float32).astype(float)
    X[rng.random(X.shape) < 0.55] = 0
    X[:, 5] = 7.25
    m = make_matrix(X, ["A"] * 300)
    got = table(P.gene_moments(m.expr, m.cells, m.genes), "gene")
    np.testing.assert_allclose([got[f"g{j}"].mean for j in range(6)], X.mean(0), rtol=1e-11)
    np.testing.assert_allclose([got[f"g{j}"].variance for j in range(6)], X.var(0), rtol=1e-9, atol=1e-11)
    assert got["g5"].variance >= 0
