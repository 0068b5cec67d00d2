"""Quantiles by selection, and profiles without a buffer of all totals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertmatrix.operators import cells as C, emit, profile as PR, ranking


def test_quantiles_of_any_values(spark):
    rng = np.random.default_rng(9)
    groups = {
        "whole": rng.integers(0, 50, 400), "fractions": rng.normal(size=501), "close": 7 + rng.random(600) * 1e-3, "equal": np.full(90, 2.5), "one": np.array([-3.0]),
        "two": np.array([1.0, 2.0]), "wide": rng.choice([-1, 1], 300) * np.exp(rng.uniform(-600, 600, 300)),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("whole", None), ("none", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    qs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in ranking.exact_quantiles(df.filter("g IS NOT NULL"), ["g"], "v", qs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, qs).tolist(), rel=1e-12)
    every = np.concatenate([*groups.values(), [4.0]])
    assert ranking.exact_quantiles(df, [], "v", [0.5]).first()["q"] == pytest.approx([np.median(every)])
    assert ranking.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_fractional_totals_in_profiles_and_filters(spark, make_matrix):
    rng = np.random.default_rng(10)
    X = rng.random((41, 5)) * (rng.random((41, 5)) < 0.7)
    m = make_matrix(X, ["a"] * 41, contexts=["u" if i < 20 else "v" for i in range(41)])
    row = PR.profile_matrix(m).first()
    totals = X.sum(axis=1)
    assert row["umi_median"] == pytest.approx(np.median(totals)) and row["median_genes_detected"] == np.median((X > 0).sum(axis=1)) and not row["integral_counts"]
    kept = C.filter_libsize_quantiles(C.cell_libsize(m), 0.2, 0.8)
    want = {i for part in (range(20), range(20, 41)) for i in part if np.quantile(totals[list(part)], 0.2) - 1e-12 <= totals[i] <= np.quantile(totals[list(part)], 0.8) + 1e-12}
    assert {r["cell_id"] for r in kept.collect()} == want
    plan = PR.profile_matrix(m)._jdf.queryExecution().executedPlan().toString() + emit.median_depth(C.cell_libsize(m))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "median(" not in plan.lower()


def test_dataset_profile_counts_columns_in_one_pass(spark, make_matrix):
    labels = ["non-targeting"] * 30 + ["A"] * 12 + ["B"] * 3
    m = make_matrix(np.ones((45, 2)), labels, contexts=[None if i == 0 else "uvw"[i % 3] for i in range(45)])
    row = PR.profile_dataset(m).first()
    assert (row["n_cells"], row["n_perturbations"], row["n_control_cells"], row["n_unique_context"], row["n_unique_batch"], row["perts_ge_10"]) == (45, 2, 30, 3, 1, 1)
