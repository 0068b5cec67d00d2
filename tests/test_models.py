import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from pertmatrix.operators import cells as C, effects as FX, emit, expression, predictors as R, pseudobulk as P

CTRL = "non-targeting"


@pytest.fixture(scope="module")
def train(make_matrix):
    rng = np.random.default_rng(0)
    labels = np.array([CTRL] * 100 + ["SYM0"] * 40 + ["SYM1"] * 30 + ["rare"] * 4)
    genes = [f"SYM{j}" for j in range(8)]
    X = np.log1p(rng.poisson(1.2, size=(len(labels), 8)).astype(float))
    X[labels == "SYM0", 0] = 0
    X[labels == "SYM1", 1] = 0
    m = make_matrix(X, labels, genes)
    return X, labels, m, m.expr.join(m.cells, "cell_id")


@pytest.fixture(scope="module")
def moments(train):
    _, _, m, entries = train
    return P.label_moments(entries, m.cells, m.genes).cache()


def test_backbone_features_and_knockdown(train, moments):
    X, labels, _, _ = train
    c = X[labels == CTRL]
    D, Z = [], []
    for lab in ("SYM0", "SYM1"):
        x = X[labels == lab]
        D.append(x.mean(0) - c.mean(0))
        Z.append(D[-1] / np.maximum(np.sqrt(c.var(0) / len(c) + x.var(0) / len(x)), 1e-9))
    fitted = R.training_deltas(moments)
    feat = table(R.backbone_features(fitted), "gene")
    for name, want in {
        "mean_delta": np.mean(D, 0), "deg_frequency": (np.abs(Z) > 2).mean(0), "mean_expression": c.mean(0),
        "gene_variance": c.var(0), "effect_size_prior": np.abs(D).mean(0),
    }.items():
        np.testing.assert_allclose([feat[f"SYM{j}"][name] for j in range(8)], want, rtol=1e-9, atol=1e-12)
    kd = R.mean_self_knockdown(fitted)
    assert kd.first().knockdown == pytest.approx((D[0][0] + D[1][1]) / 2) and kd.first().knockdown < 0


def test_backbone_delta_for_seen_unseen_and_unmeasured(spark, moments):
    fitted = R.training_deltas(moments)
    feat, kd = R.backbone_features(fitted), R.mean_self_knockdown(fitted)
    req = spark.createDataFrame([("SYM0",), ("SYM7",), ("other",)], "target_gene string")
    got = table(R.backbone_delta(req, feat, kd, scale=2.0), "target_gene", "gene")
    f, k = table(feat, "gene"), kd.first().knockdown
    assert got[("SYM0", "SYM0")].delta == k and got[("SYM7", "SYM7")].delta == k
    assert got[("other", "SYM3")].delta == pytest.approx(2 * f["SYM3"].deg_frequency * f["SYM3"].mean_delta)
    plain = table(R.backbone_delta(req, feat, kd, apply_knockdown=False), "target_gene", "gene")
    assert plain[("SYM0", "SYM0")].delta == pytest.approx(f["SYM0"].deg_frequency * f["SYM0"].mean_delta)


def test_no_self_delta_learnt_gives_zero(moments):
    fitted = R.training_deltas(moments.withColumn("target_gene", F.when(F.col("target_gene") == CTRL, CTRL).otherwise("elsewhere")))
    assert R.mean_self_knockdown(fitted).first().knockdown == 0.0


def test_mean_perturbation_is_cell_weighted(train, moments):
    X, labels, _, _ = train
    got = table(R.mean_perturbation_delta(moments), "gene")
    want = X[labels != CTRL].mean(0) - X[labels == CTRL].mean(0)
    np.testing.assert_allclose([got[f"SYM{j}"].delta for j in range(8)], want, atol=1e-12)


def test_predicted_cells_are_shifted_control_cells(spark, train):
    X, labels, m, entries = train
    rng = np.random.default_rng(3)
    shift = {lab: rng.normal(scale=0.8, size=8) for lab in ("SYM0", "other")}
    deltas = spark.createDataFrame(
        [(lab, j, f"SYM{j}", float(v)) for lab, vec in shift.items() for j, v in enumerate(vec)],
        "target_gene string, gene_pos bigint, gene string, delta double",
    )
    req = spark.createDataFrame([("SYM0", 5000), ("other", 7), ("none", 0)], "target_gene string, n bigint")
    floor = X[labels == CTRL][X[labels == CTRL] > 0].min()
    out = R.predict_cells(req, deltas, entries, m.cells, m.genes, seed=2, include_control=9).toPandas()
    assert (out.value >= floor).all() and set(out.target_gene) == {"SYM0", "other", CTRL}
    control = X[labels == CTRL]
    for lab, vec in {**shift, CTRL: np.zeros(8)}.items():
        allowed = np.maximum(control + vec, 0)
        allowed[allowed < floor] = 0
        allowed = {tuple(np.round(r, 9)) for r in allowed}
        part = out[out.target_gene == lab]
        for _, cell in part.groupby("cell_no"):
            row = np.zeros(8)
            row[cell.gene_pos] = cell.value
            assert tuple(np.round(row, 9)) in allowed
    assert out[out.target_gene == "SYM0"].cell_no.nunique() == 5000
    free = R.predict_cells(req, deltas, entries, m.cells, m.genes, seed=2, snap_to_floor=False).toPandas()
    assert (free.value < floor).any() and (free.value > 0).all()


def test_rank_test_equals_brute_force(make_matrix):
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(size=(60, 4)) * 2) * (rng.random((60, 4)) < 0.6)
    X[:, 3] = 0
    labels = np.array([CTRL] * 30 + ["A"] * 18 + ["B"] * 12)
    m = make_matrix(X, labels)
    got = table(expression.with_fdr(expression.wilcoxon(m.expr.join(m.cells, "cell_id"), m.cells, m.genes)), "target_gene", "gene")
    import math

    for lab in ("A", "B"):
        ps = []
        for j in range(4):
            x, y = X[labels == lab, j], X[labels == CTRL, j]
            u = sum((a > y).sum() + 0.5 * (a == y).sum() for a in x)
            n1, n2 = len(x), len(y)
            t = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
            var = n1 * n2 / 12 * (n1 + n2 + 1 - (t**3 - t).sum() / ((n1 + n2) * (n1 + n2 - 1)))
            z = (u - n1 * n2 / 2) / math.sqrt(var) if var > 1e-12 else 0.0
            r = got[(lab, f"g{j}")]
            assert r.u == u and r.z == pytest.approx(z, abs=1e-9) and (r.n_pert, r.n_ctrl) == (n1, n2)
            ps.append(math.erfc(abs(z) / math.sqrt(2)))
            assert r.p == pytest.approx(ps[-1], abs=1e-12)
        order = np.argsort(ps)
        q = np.minimum.accumulate((np.array(ps)[order] * 4 / np.arange(1, 5))[::-1])[::-1]
        np.testing.assert_allclose([got[(lab, f"g{j}")].fdr for j in order], np.minimum(q, 1))


def test_even_cells_have_exact_totals_and_least_spread(spark, make_matrix):
    rng = np.random.default_rng(5)
    X = rng.poisson(rng.gamma(0.5, 2.0, size=40) * rng.uniform(5, 15, size=(120, 1)))
    m = make_matrix(X, [CTRL] * 120)
    profile, libsizes = emit.context_profile(C.labelled(m), m.genes)
    frac = table(profile, "gene")
    cpm = (X / X.sum(1, keepdims=True)).mean(0)
    np.testing.assert_allclose([frac[f"g{j}"].fraction for j in range(40)], cpm / cpm.sum())
    req = spark.createDataFrame([("A", "p", 400)], "context string, target_gene string, n bigint")
    shifts = m.genes.select(F.lit("p").alias("target_gene"), "gene", F.when(F.col("gene") == "g1", F.lit(float("nan"))).otherwise(0.0).alias("shift"))
    totals = emit.even_totals(emit.shift_fraction(profile, shifts), emit.median_depth(libsizes), req)
    out = emit.allocate_even(totals, seed=1).toPandas()
    M = np.zeros((400, 40))
    M[out.cell_no, out.gene.str[1:].astype(int)] = out.value
    np.testing.assert_array_equal(M.sum(0), np.rint(400 * np.median(X.sum(1)) * cpm / cpm.sum()))
    assert (M.max(0) - M.min(0)).max() <= 1 and (out.value > 0).all()
    assert M.sum(1).max() - M.sum(1).min() <= 40


def test_effects_shrink_pool_and_transfer(spark):
    genes = spark.createDataFrame([(j, f"g{j}", "") for j in range(3)], "gene_pos bigint, gene string, ensembl_id string")
    eff = spark.createDataFrame(
        [("s1", "g0", "g0", 1.0, 0.01), ("s2", "g0", "g0", 3.0, 0.04), ("s1", "g0", "g1", 1.0, 2.0), ("s1", "t", "g2", -1.0, 0.5), ("s1", "t", "zz", 9.0, 0.5)],
        "context string, target_gene string, gene string, log2fc double, var double",
    )
    shrunk = {(r.context, r.gene): r.log2fc for r in FX.shrink(eff).collect()}
    assert shrunk[("s1", "g0")] == pytest.approx(0.99) and shrunk[("s1", "g1")] == 0.0
    targets = spark.createDataFrame([("g0",), ("t",), ("new",)], "target_gene string")
    pooled = table(FX.pooled_for_targets(targets, eff, genes), "target_gene", "gene")
    w = (100, 25)
    assert pooled[("g0", "g0")].pooled == pytest.approx((0.99 * w[0] + 3 * (1 - 0.04 / 9) * w[1]) / sum(w))
    assert pooled[("t", "g0")].pooled == 0.0 and pooled[("new", "g0")].pooled is None
    generic = spark.createDataFrame([("g0", 0.1), ("g1", 0.2), ("g2", 0.3)], "gene string, shift double")
    got = table(FX.transfer_delta(targets, eff, genes, fallback=generic, alpha=2.0), "target_gene", "gene")
    assert got[("g0", "g0")].shift == -2.32, "the target's own gene is set after scaling"
    assert got[("t", "g2")].shift == pytest.approx(2 * -0.5) and got[("new", "g1")].shift == pytest.approx(0.4)
    assert not got[("new", "g1")].covered
    bare = table(FX.transfer_delta(targets, eff, genes), "target_gene", "gene")
    assert bare[("new", "g1")].shift is None


def test_remap_last_duplicate_wins(spark):
    target = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "gene_pos bigint, gene string")
    source = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "x")], "gene_pos bigint, gene string")
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "gene_pos bigint, value double")
    out = FX.remap_to_axis(values, source, target, fill=-1.0).orderBy("gene_pos").collect()
    assert [r.value for r in out] == [2.0, 3.0, -1.0]


def test_predicted_cells_of_partial_deltas_and_bad_requests(spark, train):
    X, labels, m, entries = train
    some = [(0, 5.0), (2, 8.0), (7, 3.0)]  # genes 1 and 3 to 6 have no delta
    deltas = spark.createDataFrame([("other", j, f"SYM{j}", v) for j, v in some], "target_gene string, gene_pos bigint, gene string, delta double")
    req = lambda *r: spark.createDataFrame(list(r), "target_gene string, n bigint")
    out = R.predict_cells(req(("other", 40)), deltas, entries, m.cells, m.genes, seed=2, snap_to_floor=False).toPandas()
    vec = np.zeros(8)
    for j, v in some:
        vec[j] = v
    allowed = {tuple(np.round(r, 9)) for r in X[labels == CTRL] + vec}
    for _, cell in out.groupby("cell_no"):
        row = np.zeros(8)
        row[cell.gene_pos] = cell.value
        assert tuple(np.round(row, 9)) in allowed
    with pytest.raises(ValueError, match="no cells are requested"):
        R.predict_cells(req(("other", 0)), deltas, entries, m.cells, m.genes)
    with pytest.raises(Exception, match="no delta for label strange"):
        R.predict_cells(req(("strange", 3)), deltas, entries, m.cells, m.genes).collect()
