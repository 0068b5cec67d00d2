"""Distance ranks against all pairs, and blocks that are settled unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pertmatrix.operators import metrics as Q


def grids(spark, P, R):
    def frame(X):
        return spark.createDataFrame([(c, f"L{i}", g, float(v)) for c, M in X.items() for i, row in enumerate(M) for g, v in enumerate(row)], "context string, target_gene string, gene_pos bigint, delta double")

    return frame(P), frame(R)


def brute(P, R, kind):
    out = {}
    for c in P:
        d = np.round(Q._distances(P[c], R[c], kind), 9)
        for i in range(len(P[c])):
            out[c, f"L{i}"] = int((np.delete(d[i], i) < d[i, i]).sum())
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    R = {"u": rng.normal(size=(90, 6)) * np.exp(rng.uniform(-3, 4, (90, 1))), "v": rng.normal(size=(7, 6))}
    P = {c: M + rng.normal(size=M.shape) * 0.2 * np.abs(M).mean(axis=1, keepdims=True) for c, M in R.items()}
    R["u"][5], P["u"][6], R["u"][11] = 0, 0, R["u"][12]  # without direction, and repeated
    P["u"][20] = -5 * R["u"][20]
    return P, R


@pytest.mark.parametrize("kind", ["l1", "cosine"])
@pytest.mark.parametrize("block", [1, 8, 256])
def test_counts_equal_all_pairs(spark, monkeypatch, vectors, kind, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    P, R = vectors
    pred, real = grids(spark, P, R)
    got = Q.discrimination(pred, real, [kind], ["context"]).collect()
    assert {(r["context"], r["target_gene"]): r["n_closer"] for r in got} == brute(P, R, kind)
    assert {r["context"]: r["n_real"] for r in got} == {"u": 90, "v": 7}
    one = Q.discrimination(pred.filter("context = 'u'").drop("context"), real.filter("context = 'u'").drop("context"), [kind]).collect()
    assert {("u", r["target_gene"]): r["n_closer"] for r in one} == {k: v for k, v in brute(P, R, kind).items() if k[0] == "u"}


def test_most_blocks_are_settled_unread(spark, monkeypatch, vectors):
    monkeypatch.setattr(Q, "BLOCK", 4)
    P, R = vectors
    pred, real = grids(spark, {"u": P["u"]}, {"u": R["u"]})
    left, right = Q.block_pairs(pred, real, "l1", ["context"])
    blocks = right.select("rb").distinct().count()
    read = left.agg(F.sum(F.size("read"))).first()[0]
    assert blocks > 15 and read < 0.4 * blocks * 90
    assert left.columns.count("rv") == 0
