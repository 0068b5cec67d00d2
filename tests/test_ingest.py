import hashlib
import json

import numpy as np
import pytest
from conftest import table
from pyspark.sql import functions as F

from pertmatrix.matrix import CountMatrix, packed_cells
from pertmatrix.operators import axis, cells as C, contract as K, edges as E, manifest as M
from pertmatrix.session import scratch_path
from pertmatrix.sources import pages as PG, scans, sinks
from pertmatrix.sources.harmonize import harmonize

# -- labels and counts state -----------------------------------------------------------------


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "target_gene string")


def test_a_control_label_is_text_and_no_pattern(spark):
    pool = labels(spark, ["scr.1", "scr-1", "scr.1", "scr.10", "SCR.1 (b)", None, "50%_mix", "50xymix"])
    assert [r[0] for r in C.control_cells(pool, "scr.1").collect()] == ["scr.1"] * 2
    near = lambda text: [r[0] for r in C.near_control_labels(pool, text).collect()]
    assert near("scr.1") == ["SCR.1 (b)", "scr.10"] and near("50%_") == ["50%_mix"] and near("(B)") == ["SCR.1 (b)"]
    for text in (".*", "50%", "SCR.1"):
        with pytest.raises(ValueError, match="on no cell"):
            C.control_cells(pool, text)


def test_five_similar_labels_are_named(spark):
    pool = labels(spark, [f"plate {k} mock" for k in range(8)] * 3)
    with pytest.raises(ValueError) as refused:
        C.control_cells(pool, "mock")
    assert [f"plate {k} mock" in str(refused.value) for k in range(8)] == [True] * 5 + [False] * 3
    with pytest.raises(ValueError) as refused:
        C.control_cells(pool, "water")
    assert "Similar" not in str(refused.value)


def changed(X, at, value):
    X = X.astype(float)
    X[at] = value
    return X


@pytest.mark.parametrize("made, state", [
    (lambda X: X, C.RAW), (lambda X: changed(X, 5, 0), C.RAW), (lambda X: X[:1], C.RAW), (lambda X: 0 * X, C.RAW), (lambda X: X * (1 + 1e-9), C.RAW),
    (np.log1p, C.TRANSFORMED), (np.sqrt, C.TRANSFORMED), (lambda X: X - X.mean(axis=0).round(), C.TRANSFORMED),
    (lambda X: changed(X, (11, 4), 0.5), C.TRANSFORMED), (lambda X: changed(X, (0, 0), -1), C.TRANSFORMED),
    (lambda X: np.sort(X[:1].repeat(6, axis=0) + 7 * np.eye(6, 5)[[0, 1, 2, 3, 4, 0]]), C.TRANSFORMED),
], ids="counts empty-cell one-cell nothing rounding logs roots centred one-half one-negative equal-totals".split())
def test_counts_state(make_matrix, made, state):
    counts = np.random.default_rng(4).poisson(3, (12, 5)) + np.arange(12)[:, None]
    X = made(counts)
    m = make_matrix(X, ["a"] * len(X))
    alone = C.rows_state(packed_cells(m.cells, m.expr)).first()
    assert C.counts_state(m.expr, m.cells).first() == alone and alone.state == state


def test_cp10k_scales_packed_rows_in_their_place(make_matrix):
    counts = np.random.default_rng(6).integers(0, 40, (30, 7)) + np.eye(30, 7, dtype=int)
    counts[:, 6] += np.arange(30) + 1
    m = make_matrix(counts, ["a", "b", "c"] * 10)
    out = C.cp10k(m)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    packed = CountMatrix(m.cells, m.genes, m.expr, packed_cells(m.cells, m.expr))
    for frame in (out, C.cp10k(packed)):
        got = {(r.cell_id, r.gene): r.value for r in frame.collect()}
        assert got == {(i, f"g{j}"): pytest.approx(1e4 * counts[i, j] / counts[i].sum()) for i, j in zip(*np.nonzero(counts))}


def test_cp10k_refuses_what_it_cannot_scale(make_matrix):
    counts = np.random.default_rng(8).integers(1, 9, (6, 4)) * np.arange(1, 7)[:, None]
    for X, reason in ((np.log1p(counts), "expected raw integer counts"), (changed(counts, 3, 0), "zero total"), (counts[:0], "empty")):
        with pytest.raises(ValueError, match=reason):
            C.cp10k(make_matrix(X, ["a"] * len(X)))


# -- axis and edges --------------------------------------------------------------------------


def test_id_column_is_found_by_shape(spark):
    genes = spark.createDataFrame([(i, f"S{i}", f"S{i}", f"ENSG{i:011d}") for i in range(10)], "gene_pos bigint, gene string, gene_id string, ensembl string")
    assert axis.resolve_id_column(genes, "ensembl_gene_id") == "ensembl"
    assert axis.resolve_id_column(genes, "hgnc_symbol") == "gene"
    with pytest.raises(ValueError, match="comes closest"):
        axis.resolve_id_column(genes.drop("ensembl"), "ensembl_gene_id")
    with pytest.raises(ValueError, match="unknown id type"):
        axis.resolve_id_column(genes, "entrez")


def test_first_duplicate_and_coverage(spark):
    genes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "gene_pos bigint, gene string")
    index = axis.gene_index(genes, "gene")
    assert {r.gene_id: (r.gene_pos, r.n_seen) for r in index.collect()} == {"a": (0, 2), "b": (1, 1)}
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert axis.require_coverage(ids("a", "a", "z"), index, "id", "src") == pytest.approx(2 / 3)
    with pytest.raises(ValueError, match="another kind"):
        axis.require_coverage(ids("x", "y"), index, "id", "src")
    assert axis.coverage(ids(), index, "id").first().coverage == 0.0


def test_edges_drop_as_pairs(spark):
    index = axis.gene_index(spark.createDataFrame([(i, f"g{i}") for i in range(4)], "gene_pos bigint, gene string"), "gene")
    edges = spark.createDataFrame([("g0", "g1", 1), ("xx", "g2", 2), ("g3", "yy", 3), ("g2", "g2", 4)], "src string, dst string, score int")
    rows = {(r.src_pos, r.dst_pos, r.score) for r in E.align_edges(edges, index).collect()}
    assert rows == {(0, 1, 1), (2, 2, 4)}
    assert E.align_edges(edges, index, drop_self_loops=True).count() == 1
    assert {r.rule: r.n for r in E.edge_violations(E.align_edges(edges, index), 2).collect()} == {"position out of range": 1}
    spec = {"layer": "trans", "relation": "r", "name": "n"}
    with pytest.raises(ValueError, match="duplicate edge type"):
        E.union_typed([(spec, edges), (spec, edges)])


# -- contract --------------------------------------------------------------------------------


@pytest.fixture
def contract(spark):
    genes = spark.createDataFrame([(i, f"G{i}") for i in range(3)], "gene_pos bigint, gene string")
    return K.Contract(genes, labels(spark, ["P", "Q"]), ("A", "B"), cells_per_pert=2)


def full_cells(spark):
    rows = [(f"{c}{p}{i}", c, p) for c in "AB" for p in "PQ" for i in range(2)]
    return spark.createDataFrame(rows, "cell_id string, context string, target_gene string")


def test_a_sound_prediction_is_written_and_read_back(spark, contract):
    cells = full_cells(spark)
    entries = spark.createDataFrame([("AP0", "G2", 4.0), ("AP0", "G0", 1.0), ("BQ1", "G1", 0.0)], "cell_id string, gene string, value double")
    back = table(spark.read.parquet(sinks.write_prediction(contract, cells, entries, scratch_path(spark, "p"))), "cell_id")
    assert len(back) == 8 and list(back["AP0"].idx) == [0, 2] and list(back["AP0"].val) == [1.0, 4.0] and back["BQ1"].idx == []


@pytest.mark.parametrize("value, rule", [(1.5, "fractional"), (-1.0, "negative"), (1e9, "total over the cap"), (float("inf"), "non-finite"), (float("nan"), "non-finite")])
def test_bad_values_are_refused(spark, contract, value, rule):
    entries = spark.createDataFrame([("AP0", "G2", value)], "cell_id string, gene string, value double")
    with pytest.raises(K.ContractError, match=rule):
        sinks.write_prediction(contract, full_cells(spark), entries, scratch_path(spark, "p"))


def test_incomplete_predictions_are_refused(spark, contract):
    none = spark.createDataFrame([], "cell_id string, gene string, value double")
    cells = full_cells(spark)
    with pytest.raises(K.ContractError, match="missing block"):
        sinks.write_prediction(contract, cells.filter("target_gene = 'P' or context = 'A'"), none, scratch_path(spark, "p"))
    with pytest.raises(K.ContractError, match="wrong count"):
        sinks.write_prediction(contract, cells.filter("cell_id != 'AP0'"), none, scratch_path(spark, "p"))
    extra = spark.createDataFrame([("c", "A", "non-targeting"), ("d", "Z", "P")], cells.schema)
    found = {r.rule for r in K.completeness_violations(contract, cells.union(extra)).union(K.value_violations(contract, cells.union(extra), none)).collect()}
    assert found == {"unexpected block", "control rows present", "unknown context", "unknown perturbation"}


def test_unsound_contracts(spark, contract):
    twice = K.Contract(contract.genes.union(contract.genes), labels(spark, ["P", "P", "non-targeting"]), ("A",), cells_per_pert=200_000)
    assert {r.rule for r in K.contract_violations(twice).collect()} == {
        "duplicate gene", "duplicate perturbation", "control listed as perturbation", "contract exceeds the cell cap"}
    assert K.contract_violations(contract).isEmpty()


# -- manifests and files ---------------------------------------------------------------------


def record(files, license="cc-by-4.0"):
    return json.dumps({"id": "r", "metadata": {"title": "t", "license": {"id": license} if license else None},
                       "files": [{"key": n, "size": s, "checksum": c, "links": {"self": "u"}} for n, s, c in files]})


@pytest.mark.parametrize("files, license, budget, reason", [
    ([("a", 60, "md5:1"), ("b", 40, "md5:2")], "cc-by-4.0", 100, "ok"),
    ([("a", 60, "md5:1"), ("b", 41, "md5:2")], "cc-by-4.0", 100, "over budget"),
    ([("a", 1, "md5:1"), ("b", 1, "")], "mit", 100, "missing checksum"),
    ([("a", 1, "md5:1"), ("b", 1, "x")], None, 100, "no license"),
    ([], "mit", 100, "no files"),
])
def test_gate(spark, files, license, budget, reason):
    records, found = scans.scan_host_records(spark.createDataFrame([(record(files, license),)], "body string"), "h")
    row = M.gate(records.withColumn("budget_bytes", F.lit(budget)), found).first()
    assert row.reason == reason
    if reason == "missing checksum":
        assert M.gate(records.withColumn("budget_bytes", F.lit(budget)), found, allow_missing_checksum=True).first().reason == "ok"


def test_gate_budgets_the_selection_and_refuses_unknown_names(spark):
    records, files = scans.scan_host_records(spark.createDataFrame([(record([("a", 60, "m"), ("b", 999, "m")]),)], "body string"), "h")
    records = records.withColumn("budget_bytes", F.lit(60))
    want = lambda *n: spark.createDataFrame([("r", x) for x in n], "record_id string, name string")
    assert M.gate(records, files, wanted=want("a")).first().reason == "ok"
    assert M.gate(records, files, wanted=want("a", "zz")).first().reason == "unknown file name"


def test_licenses(spark):
    df = spark.createDataFrame([("cc-by-nc-sa-4.0",), ("CC0-1.0",), ("own terms",), ("",), (None,)], "s string")
    got = [tuple(r) for r in M.license_flags(df.select(M.spdx(F.col("s")).alias("license"))).collect()]
    assert got == [("CC-BY-NC-SA-4.0", True, True), ("CC0-1.0", False, False), ("own terms", False, False), ("unknown", False, False), ("unknown", False, False)]


def test_files_are_verified_by_size_and_md5(spark, tmp_path):
    bodies = {"good": b"x" * 20, "bad": b"y" * 20, "short": b"z", "open": b"w" * 3}
    for n, b in bodies.items():
        (tmp_path / n).write_bytes(b)
    md5 = lambda b: "md5:" + hashlib.md5(b).hexdigest()
    manifest = spark.createDataFrame(
        [("good", 20, md5(bodies["good"])), ("bad", 20, md5(b"other")), ("short", 5, "md5:0"), ("open", 3, None), ("gone", 1, "md5:0")],
        "name string, size_bytes bigint, checksum string",
    )
    got = {r.name: r.status for r in M.verify_files(manifest, M.found_files(spark, str(tmp_path))).collect()}
    assert got == {"good": "ok", "bad": "MISMATCH", "short": "SHORT", "open": "no-md5", "gone": "MISSING"}


def test_provenance_is_written_once(spark):
    records, files = scans.scan_host_records(spark.createDataFrame([(record([("a", 1, "m")]),)], "body string"), "h")
    path = sinks.write_provenance(records, files, scratch_path(spark, "prov"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_provenance(records, files, path)
    sinks.write_provenance(records, files, path, refresh=True)


# -- pages and lists -------------------------------------------------------------------------


def page(payload):
    return f'<html><script>self.__next_f.push([1,"{json.dumps(payload)[1:-1]}"])</script></html>'


def test_boards_are_read_from_the_page(spark):
    entry = {"rank": 1, "teamName": 't "]) \\', "scoreAvg": 0.5, "scorePds": 0.6, "pdsCosine": 0.7, "other": [1]}
    payload = (
        f'13:["$",{{"initialLiveLeaderboardEntries":[{json.dumps(entry)}],"initialLiveLeaderboardNumEntries":6,'
        '"initialFinalLeaderboardEntries":[],"initialFinalLeaderboardNumEntries":0}]'
    )
    df = spark.createDataFrame([("p", page("0:[]") + page(payload))], "page_id string, html string")
    boards = table(PG.require_boards(df), "board")
    assert set(boards) == {"live", "final"} and boards["live"].total == 6 and boards["final"].entries == []
    assert boards["live"].entries[0].teamName == entry["teamName"] and boards["live"].entries[0].pdsCosine == 0.7


def test_a_page_without_boards_is_an_error(spark):
    whole = page('x{"initialGeneralistEntries":[{"rank":1}]}')
    df = spark.createDataFrame([("bare", "<html>Loading...</html>"), ("none", None), ("whole", whole), ("cut", whole[:-40])], "page_id string, html string")
    bare = PG.pages_without_boards(df)
    assert sorted(r[0] for r in bare.collect()) == ["bare", "cut", "none"]
    assert "Exchange" not in bare._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="has no board"):
        PG.require_boards(df)
    assert [r.page_id for r in PG.require_boards(df.where("page_id = 'whole'")).collect()] == ["whole"]


def test_a_page_is_decoded_once(spark):
    plan = PG.board_entries(spark.createDataFrame([("p", "x")], "page_id string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_long_pages_do_not_overflow_the_pattern(spark):
    entries = [{"rank": i, "teamName": '"' * 50} for i in range(5000)]
    df = spark.createDataFrame([("p", page(f'x{{"initialGeneralistEntries":{json.dumps(entries)}}}'))], "page_id string, html string")
    assert PG.board_rows(PG.board_entries(df)).count() == 5000


def test_lists(spark, tmp_path):
    (tmp_path / "k.csv").write_text("name,n\nB,1\nA,2\nB,3\n")
    assert {r[0] for r in scans.scan_label_list(spark, str(tmp_path / "k.csv")).collect()} == {"A", "B"}
    (tmp_path / "g.csv").write_text("gene_name\nA\nB\n")
    axis_df, header = scans.scan_gene_axis(spark, str(tmp_path / "g.csv"), 2)
    assert header and [(r.gene_pos, r.gene) for r in axis_df.orderBy("gene_pos").collect()] == [(0, "A"), (1, "B")]
    assert not scans.scan_gene_axis(spark, str(tmp_path / "g.csv"), 3)[1]
    with pytest.raises(ValueError, match="expected 7"):
        scans.scan_gene_axis(spark, str(tmp_path / "g.csv"), 7)
    with pytest.raises(Exception, match="(?i)path"):
        scans.scan_matrix(spark, str(tmp_path / "absent"))
    specs = scans.parse_source_specs(["s3://x/a:ctrl", "s3://x/b", "plain", "c:"])
    assert specs == [("s3://x/a", "ctrl"), ("s3://x/b", "control"), ("plain", "control"), ("c", "control")]


def test_harmonize(spark):
    cells = spark.createDataFrame([("c1", "NTC"), ("c2", "TP53")], "bc string, pert string")
    genes = spark.createDataFrame([(0, "A"), (1, "B")], "gene_pos bigint, gene string")
    expr = spark.createDataFrame([("c1", "A", 3)], "bc string, gene string, value int")
    ids = spark.createDataFrame([("A", "ENSG1"), ("A", "ENSG2")], "gene string, ensembl_id string")
    spec = {"cell_id": "bc", "pert_col": "pert", "control_label": "NTC", "context": "K562"}
    m = harmonize(cells, genes, expr, spec, ids)
    assert {(r.cell_id, r.target_gene, r.context) for r in m.cells.collect()} == {("c1", "non-targeting", "K562"), ("c2", "TP53", "K562")}
    assert {(r.gene, r.ensembl_id) for r in m.genes.collect()} == {("A", "ENSG1"), ("B", None)}
    with pytest.raises(ValueError, match="id map"):
        harmonize(cells, genes, expr, spec)
    with pytest.raises(KeyError):
        harmonize(cells, genes, expr, {**spec, "pert_col": "nope"}, ids)
