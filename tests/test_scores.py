import numpy as np
import pytest
from conftest import table

from pertmatrix.operators import metrics as Q


def frame(spark, M, labels, key="k"):
    rows = [(key, lab, j, f"g{j}", float(v)) for lab, row in zip(labels, M) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "key string, target_gene string, gene_pos bigint, gene string, delta double")


@pytest.mark.parametrize("block", [2, 256])
def test_discrimination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = np.random.default_rng(2)
    labels = [f"p{i}" for i in range(7)]
    R = rng.normal(size=(7, 5))
    P = R + rng.normal(size=(7, 5))
    P[6] = 0
    got = table(Q.discrimination(frame(spark, P, labels), frame(spark, R, labels), ["l1", "cosine"], ["key"]), "target_gene", "kind")
    for i, lab in enumerate(labels):
        l1 = np.abs(R - P[i]).sum(1)
        assert got[(lab, "l1")].n_closer == (l1 < l1[i]).sum() and got[(lab, "l1")].n_real == 7
        norm = np.linalg.norm(R, axis=1) * np.linalg.norm(P[i])
        cos = 1 - np.divide(R @ P[i], norm, out=np.zeros(7), where=norm > 0)
        assert got[(lab, "cosine")].score == pytest.approx(1 - (cos < cos[i] - 1e-9).sum() / 7)
    with pytest.raises(ValueError):
        Q.discrimination(frame(spark, P, labels), frame(spark, R, labels), ["l3"])


def test_errors_and_undefined_correlation(spark):
    rng = np.random.default_rng(1)
    P, R = rng.normal(size=(2, 6)), rng.normal(size=(2, 6))
    P[1] = 0.25
    got = table(Q.error_metrics(Q.paired(frame(spark, P, "ab"), frame(spark, R, "ab"))), "target_gene")
    assert got["a"].mae == pytest.approx(np.abs(P[0] - R[0]).mean()) and got["b"].mse == pytest.approx(((P[1] - R[1]) ** 2).mean())
    assert got["a"].pearson_delta == pytest.approx(np.corrcoef(P[0], R[0])[0, 1]) and got["b"].pearson_delta is None


def test_significance_scores(spark):
    zp = {"g0": 3.0, "g1": -2.0, "g2": 0.1, "g3": 1.5}
    zr = {"g0": 2.5, "g1": 0.2, "g2": -1.7, "g3": -1.2}
    side = lambda z: spark.createDataFrame([("a", g, v) for g, v in z.items()] + [("quiet", "g0", 0.0)], "target_gene string, gene string, z double")
    pairs = Q.significance_pairs(side(zp), side(zr), 1.0)
    overlap, precision = table(Q.overlap_at(pairs, "sig_r"), "target_gene"), table(Q.overlap_at(pairs, "sig_p"), "target_gene")
    assert (overlap["a"].n, overlap["a"].n_shared) == (3, 2) and overlap["quiet"].value is None
    assert (precision["a"].n, precision["a"].n_shared) == (3, 2)
    assert table(Q.significance_jaccard(pairs), "target_gene")["a"].value == pytest.approx(2 / 4)
    assert table(Q.significance_jaccard(pairs), "target_gene")["quiet"].value is None
    assert table(Q.direction_agreement(pairs), "target_gene")["a"].value == pytest.approx(1 / 3)
    assert table(Q.n_significant(pairs), "target_gene")["a"].nsig_pred == 3
    lfc = lambda d: spark.createDataFrame([("a", g, v) for g, v in d.items()], "target_gene string, gene string, log2fc double")
    err = Q.fold_change_error(pairs, lfc({"g0": 1.0, "g1": 5.0, "g2": 0.0, "g3": 1.0}), lfc({"g0": 2.0, "g1": 0.0, "g2": -1.0, "g3": 1.0}))
    assert err.first().value == pytest.approx(2 / 4)


def test_anchors_are_clamped_floored_and_averaged(spark):
    rows = lambda v: spark.createDataFrame([("A", m, x) for m, x in v.items()], "context string, metric string, value double")
    user = rows({"mse": -9.0, "lfc_nmae": 50.0, "pds_l1": 0.7, "mae": 1.0})
    base = rows({"mse": 1.0, "lfc_nmae": 1.0, "pds_l1": 0.5, "mae": 2.0})
    top = rows({"mse": 0.0, "lfc_nmae": 0.5, "pds_l1": 0.9, "mae": 2.0 + 1e-12})
    scaled = Q.scale_to_anchors(user, base, top, ["context"])
    got = {r.metric: r.scaled for r in scaled.collect()}
    assert got["mse"] == 1.0 and got["lfc_nmae"] == -6.0 and got["pds_l1"] == pytest.approx(0.5) and got["mae"] is None
    assert Q.overall(scaled).first().overall == pytest.approx((1 - 6 + 0.5) / 3)


def test_guards_and_names(spark):
    v = lambda x: spark.createDataFrame([(x,)], "mean_var double")
    assert Q.variance_inflation(v(16.0), v(1.0)).first().flagged and not Q.variance_inflation(v(1.5), v(1.0)).first().flagged
    assert Q.variance_inflation(v(1.0), v(0.0)).first().variance_ratio == float("inf")
    with pytest.raises(ValueError, match="unknown metrics"):
        Q.check_metric_names(["mae", "auroc"])
    s = lambda rows: spark.createDataFrame(rows, "model string, metric string, value double")
    out = Q.private_gain_guard(s([("b", "mae", 1.0), ("m", "mae", 0.5)]), s([("b", "mae", 1.0), ("m", "mae", 1.0)]), "b").first()
    assert out.gain_public == 0.5 and out.gain_private == 0.0 and out.blocked
    gap = {r.metric: r.gap for r in Q.generalization_gap(s([("", "x", 2.0), ("", "y", 1.0)]), s([("", "x", 0.5)])).collect()}
    assert gap == {"x": 1.5, "y": None}


def test_e_distance_equals_pairwise(spark):
    rng = np.random.default_rng(0)
    X = {0: rng.normal(size=(9, 3)), 1: rng.normal(1, 2, size=(6, 3))}
    df = spark.createDataFrame([(g, [float(x) for x in row]) for g, M in X.items() for row in M], "g int, v array<double>")
    sq = lambda a, b: ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    within = {g: sq(M, M).sum() / (len(M) * (len(M) - 1)) for g, M in X.items()}
    want = 2 * sq(X[0], X[1]).mean() - within[0] - within[1]
    assert Q.e_distance(df, "g", "v", 0).first().e_distance == pytest.approx(want)


def test_ladder_report_ranks_by_direction(spark):
    s = spark.createDataFrame([("a", "mae", 1.0), ("b", "mae", 2.0), ("a", "pds_l1", 0.2), ("b", "pds_l1", 0.9)], "model string, metric string, value double")
    got = table(Q.ladder_report(s, ["mae", "pds_l1"]), "model")
    assert got["a"].avg_rank == got["b"].avg_rank == 1.5 and got["a"].mae == 1.0
