"""Models and prior sources of a user's own: scored and assembled beside the given ones, refused where they break their word."""

from collections import Counter

import numpy as np
import pytest

from pertmatrix.operators import models as M, predictors as R, priors as PS
from pertmatrix.plans import cell_scores as CS

CTRL = "non-targeting"


class Fixed(M.Predictor):
    """Answers with given rows, right or wrong."""

    def __init__(self, name, rows):
        self.name, self.rows = name, rows

    def fit(self, moments):
        return moments.sparkSession.createDataFrame(self.rows, "target_gene string, gene_pos bigint, gene string, delta double")

    def deltas(self, fitted, requested, genes):
        return fitted


@pytest.fixture(scope="module")
def matrix(make_matrix):
    """Two contexts; the label p2 is measured only in the held-out one, and one held-out cell is empty."""
    rng = np.random.default_rng(5)
    labels = [CTRL] * 12 + ["g0"] * 11 + [CTRL] * 9 + ["g0"] * 5 + ["p2"] * 4
    contexts = ["A"] * 23 + ["B"] * 18
    X = rng.poisson(3, size=(len(labels), 4)) * rng.integers(0, 2, size=(len(labels), 4))
    X[:23, 3] += 1
    X[30] = 0
    return make_matrix(X, labels, contexts=contexts), X, np.array(labels), np.array(contexts)


def logged(X):
    total = X.sum(1, keepdims=True)
    return np.log1p(np.divide(X, total, out=np.zeros(X.shape), where=total > 0) * 1e4)


def vectors(df, keys):
    """{keys: [(gene, value), ...]}"""
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), []).append((r.gene, r.value))
    return out


def test_groups_hold_predictions_and_the_real_controls(spark, matrix):
    m, X, labels, contexts = matrix
    groups = CS.ladder_groups(m, M.RUNGS, "B")
    sizes = Counter((r.context, r.target_gene) for r in groups.cells.collect())
    for side in ("real", "rung0", "rung0b", "rung1"):
        assert {k[1]: n for k, n in sizes.items() if k[0] == f"{side}|B"} == {CTRL: 9, "g0": 5, "p2": 4}
    got = vectors(groups.entries, ["context", "target_gene"])
    L = logged(X)
    assert got[("rung0|B", CTRL)] and sorted(got[("rung0|B", CTRL)]) == sorted(got[("real|B", CTRL)])
    pool = {round(v, 9) for v in L[(contexts == "A") & (labels == CTRL)].ravel() if v > 0}
    drawn = {round(v, 9) for _, v in got[("rung0|B", "p2")] + got[("rung0|B", "g0")]}
    assert drawn and drawn <= pool, "rung 0 draws control cells of the other contexts and leaves them as they are"


def test_members_of_predicted_cells_against_plain_python(spark, matrix):
    """Two rungs and a model of the user's, fitted, emitted and scored together."""
    m, X, labels, contexts = matrix
    models = [M.Unchanged(), M.Backbone(), Fixed("mine", [(lab, j, f"g{j}", 0.3 * j) for lab in ("g0", "p2") for j in range(4)])]
    groups = CS.ladder_groups(m, models, "B")
    sizes = Counter((r.context, r.target_gene) for r in groups.cells.collect())
    mean, cpm = {}, {}
    for key, rows in vectors(groups.entries, ["context", "target_gene"]).items():
        for gene, v in rows:
            mean[(*key, gene)] = mean.get((*key, gene), 0) + v / sizes[key]
            cpm[(*key, gene)] = cpm.get((*key, gene), 0) + np.expm1(v) * 100 / sizes[key]
    genes = [f"g{j}" for j in range(4)]
    delta = lambda side, lab: np.array([mean.get((side, lab, g), 0) - mean.get((side, CTRL, g), 0) for g in genes])
    got = {(r.model, r.target_gene, r.metric): r.value for r in CS.ladder_scores(m, models, "B", 0.0).collect()}
    lfc = lambda side, lab: np.log2([(cpm.get((side, lab, g), 0) + 1) / (cpm.get((side, CTRL, g), 0) + 1) for g in genes])
    for model in ("rung0", "rung1", "mine"):
        for lab in ("g0", "p2"):
            want = ((delta(f"{model}|B", lab) - delta("real|B", lab)) ** 2).mean()
            assert got[(model, lab, "mse")] == pytest.approx(want)
            a, b = lfc(f"{model}|B", lab), lfc("real|B", lab)
            assert got[(model, lab, "lfc_nmae")] == pytest.approx(np.abs(a - b).sum() / np.abs(b).sum())
    assert {k[2] for k in got} == set(CS.MEMBERS)
    real = delta("real|B", "g0")
    L = logged(X)
    own = L[(contexts == "B") & (labels == "g0")].mean(0) - L[(contexts == "B") & (labels == CTRL)].mean(0)
    assert real == pytest.approx(own), "the empty cell counts as a cell"
    with pytest.raises(ValueError, match="real"):
        CS.ladder_scores(m, [Fixed("real", [])], "B", 0.5)


@pytest.mark.parametrize("change, rule", [
    (lambda rows: rows[1:], "no delta for a requested label and gene"),
    (lambda rows: [], "no delta for a requested label and gene"),
    (lambda rows: [*rows, ("g9", 0, "g0", 0.0)], "delta that was not requested"),
    (lambda rows: [*rows, (None, 0, "g0", 0.0)], "delta that was not requested"),
    (lambda rows: [*rows, rows[0]], "more than one delta"),
    (lambda rows: [*rows[1:], (*rows[0][:3], None)], "delta is not a number"),
    (lambda rows: [*rows[1:], (*rows[0][:3], float("nan"))], "delta is not a number"),
    (lambda rows: [*rows[1:], (*rows[0][:3], float("-inf"))], "delta is not a number"),
])
def test_deltas_off_the_grid_are_refused(spark, make_matrix, change, rule):
    m = make_matrix([[1, 2], [2, 1]], [CTRL, "a"])
    rows = [(lab, j, f"g{j}", 0.5) for lab in ("a", "b") for j in range(2)]
    requested = spark.createDataFrame([("a",), ("b",)], "target_gene string")
    moments = spark.createDataFrame([(CTRL, 0, "g0", 3, 1.0, 0.0)], "target_gene string, gene_pos bigint, gene string, n bigint, mean double, variance double")
    assert M.predicted_deltas([Fixed("mine", rows)], moments, requested, m.genes).count() == 4
    with pytest.raises(ValueError, match=rule):
        M.predicted_deltas([M.Unchanged(), Fixed("mine", change(rows))], moments, requested, m.genes)


def test_names_of_models(spark, make_matrix):
    m = make_matrix([[1]], [CTRL])
    requested = spark.createDataFrame([], "target_gene string")
    for models in ([], [M.Unchanged(), M.Unchanged()], [Fixed("a|b", [])]):
        with pytest.raises(ValueError, match="names"):
            M.predicted_deltas(models, requested, requested, m.genes)


def test_rungs_are_the_free_functions(spark, matrix):
    m, *_ = matrix
    from pertmatrix.operators import cells as C, pseudobulk as P

    moments = P.label_moments(C.log_normalized(C.labelled(m)), m.cells, m.genes)
    requested = spark.createDataFrame([("g0",), ("new",)], "target_gene string")
    got = {(r.model, r.target_gene, r.gene): r.delta for r in M.predicted_deltas(M.RUNGS, moments, requested, m.genes).collect()}
    seen = R.training_deltas(moments)
    want = R.backbone_delta(requested, R.backbone_features(seen), R.mean_self_knockdown(seen))
    assert {k[1:]: v for k, v in got.items() if k[0] == "rung1"} == {(r.target_gene, r.gene): pytest.approx(r.delta) for r in want.collect()}
    assert got[("rung0b", "new", "g1")] == got[("rung0b", "g0", "g1")] and not got[("rung0", "g0", "g0")]


# -- prior sources ---------------------------------------------------------------------------


class Given(PS.PriorSource):
    def __init__(self, declared, built):
        self.declared, self.built = declared, built

    def build(self, index):
        return self.built


def declared(name="s", kind=PS.EDGE, width=1, **more):
    return PS.Declared("layer", "relation", name, kind, width, **more)


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "gene_id string, gene_pos bigint")


@pytest.fixture(scope="module")
def tables(spark):
    edges = lambda rows: spark.createDataFrame(rows, "src_pos bigint, dst_pos bigint, attr array<double>")
    rows = lambda rows: spark.createDataFrame(rows, "gene_pos bigint, features array<double>")
    return edges, rows


def test_what_breaks_the_declaration(spark, index, tables):
    edges, rows = tables
    whole = [(0, [1.0]), (1, [2.0]), (2, [3.0])]
    sources = [
        Given(declared("good"), edges([(0, 1, [0.5]), (2, 0, [1.0])])),
        Given(declared("none", width=0), edges([]).drop("attr")),
        Given(declared("features", PS.FEATURE), rows(whole)),
        Given(declared("kind"), rows(whole)),
        Given(declared("other", PS.FEATURE), edges([(0, 1, [1.0])])),
        Given(declared("neither"), index),
        Given(declared("place"), edges([(0, 3, [1.0]), (-1, 0, [1.0]), (None, 1, [1.0])])),
        Given(declared("count", width=2), edges([(0, 1, [1.0, 2.0]), (0, 2, [1.0]), (1, 2, None)])),
        Given(declared("bare"), edges([(0, 1, [1.0])]).drop("attr")),
        Given(declared("genes", PS.FEATURE), rows([*whole[:2], (1, [0.0]), (7, [0.0, 1.0])])),
        Given(declared("off", enabled=False), rows(whole)),
    ]
    got = {(r.source.rsplit(":", 1)[1], r.rule): r.n for r in PS.check(sources, index).collect()}
    assert got == {
        ("kind", "built node_feature, declared edge"): 3, ("other", "built edge, declared node_feature"): 1, ("neither", "built neither kind, declared edge"): 3,
        ("place", "missing position"): 1, ("place", "position out of range"): 2, ("count", "attr: not 2 values"): 2, ("bare", "attr: not 1 values"): 1,
        ("genes", "gene without exactly one row"): 2, ("genes", "row for an unknown gene"): 1, ("genes", "features: not 1 values"): 1,
    }
    with pytest.raises(ValueError, match="layer:relation:kind.*layer:relation:place"):
        PS.assemble(sources, index)


def test_sources_become_one_graph(spark, index, tables):
    edges, rows = tables
    graph = PS.assemble([
        Given(declared("one"), edges([(0, 1, [0.5])])), Given(declared("two", width=0), edges([(0, 1, [9.0]), (1, 2, [9.0])]).drop("attr")),
        Given(declared("x", PS.FEATURE, 2), rows([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])])),
        Given(declared("y", PS.FEATURE, 1), rows([(0, [7.0]), (1, [8.0]), (2, [9.0])])),
    ], index)
    assert sorted((r.edge_type[15:], r.src_pos, r.dst_pos, r.attr) for r in graph.edges.collect()) == [("one", 0, 1, [0.5]), ("two", 0, 1, []), ("two", 1, 2, [])]
    assert {r.gene_pos: r.features for r in graph.features.collect()} == {0: [1.0, 2.0, 7.0], 1: [3.0, 4.0, 8.0], 2: [5.0, 6.0, 9.0]}
    assert PS.assemble([Given(declared(), edges([]))], index).features is None


def test_declarations(index, tables):
    edges, _ = tables
    with pytest.raises(ValueError, match="must declare"):
        declared(kind="graph")
    with pytest.raises(ValueError, match="duplicate"):
        PS.check([Given(declared(), edges([])), Given(declared(), edges([]))], index)
    with pytest.raises(ValueError, match="enabled"):
        PS.check([Given(declared(enabled=False), edges([]))], index)
