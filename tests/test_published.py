"""Staged predictions, versions of provenance, digests of byte ranges."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pertmatrix.operators import contract as K, manifest as M
from pertmatrix.session import scratch_path
from pertmatrix.sources import published as PUB


@pytest.fixture(scope="module")
def contract(spark):
    genes = spark.createDataFrame([(0, "G0"), (1, "G1"), (2, "G2")], "gene_pos bigint, gene string")
    return K.Contract(genes, spark.createDataFrame([("P",), ("Q",)], "target_gene string"), ("A", "B"), 2, max_cells=100)


def full(spark):
    return spark.createDataFrame([(f"{c}{p}{i}", c, p) for c in "AB" for p in "PQ" for i in range(2)], "cell_id string, context string, target_gene string")


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), "cell_id string, gene string, value double")


def test_a_sound_prediction_is_published_and_a_new_one_replaces_it(spark, contract):
    path = scratch_path(spark, "pub")
    with pytest.raises(ValueError, match="nothing is published"):
        PUB.read_prediction(spark, path)
    PUB.publish_prediction(contract, full(spark), entries(spark, ("AP0", "G2", 4.0), ("AP0", "G0", 1.0), ("BQ1", "G1", 0.0)), path)
    back = {r["cell_id"]: r for r in PUB.read_prediction(spark, path).collect()}
    assert len(back) == 8 and back["AP0"]["idx"] == [0, 2] and back["AP0"]["val"] == [1.0, 4.0] and back["BQ1"]["idx"] == []
    PUB.publish_prediction(contract, full(spark), entries(spark, ("BQ1", "G1", 3.0)), path)
    assert {r["cell_id"] for r in PUB.read_prediction(spark, path).filter("size(idx) > 0").collect()} == {"BQ1"}
    assert PUB.latest(spark, path)[0] == 1


@pytest.mark.parametrize("row, rule", [
    (("AP0", "G2", 1.5), "fractional"), (("AP0", "G2", -1.0), "negative"), (("AP0", "G2", float("nan")), "non-finite"), (("AP0", "G2", None), "missing values"),
    (("AP0", "nope", 2.0), "gene not on the axis"), (("lost", "G1", 2.0), "entries without a cell"),
])
def test_flaws_leave_nothing_published(spark, contract, row, rule):
    path = scratch_path(spark, "pub")
    with pytest.raises(K.ContractError, match=rule):
        PUB.publish_prediction(contract, full(spark), entries(spark, ("AP1", "G0", 1.0), row), path)
    assert PUB.latest(spark, path) is None


def test_missing_and_doubled_cells_leave_the_former_prediction(spark, contract):
    path = scratch_path(spark, "pub")
    first = PUB.publish_prediction(contract, full(spark), entries(spark, ("AP1", "G0", 1.0)), path)
    for cells, rule in ((full(spark).filter("cell_id != 'AP0'"), "wrong count"), (full(spark).union(full(spark).filter("cell_id = 'AP0'")), "doubled cell")):
        with pytest.raises(K.ContractError, match=rule):
            PUB.publish_prediction(contract, cells, entries(spark, ("AP1", "G0", 1.0)), path)
    assert PUB.latest(spark, path) == (0, first)


def test_the_emission_runs_once(spark, contract):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    emitted = entries(spark, ("AP1", "G0", 1.0), ("AP0", "G1", 2.0)).mapInPandas(count, "cell_id string, gene string, value double")
    PUB.publish_prediction(contract, full(spark), emitted, scratch_path(spark, "pub"))
    assert seen.value == 2


def test_provenance_versions(spark):
    def frames(rows, license="MIT", when="2026-01-01"):
        records = spark.createDataFrame([("r", license, "v1", when)], "record_id string, license string, version string, retrieved string")
        return records, spark.createDataFrame([("r", *x) for x in rows], "record_id string, name string, size_bytes bigint, checksum string")

    log = PUB.ProvenanceLog(spark, scratch_path(spark, "prov"))
    first = [("a", 1, "md5:1"), ("b", 2, None)]
    assert log.current() is None
    assert log.record(*frames(first)) == "written"
    assert log.record(*frames(first)) == "same"
    assert log.record(*frames(first, when="2026-02-02"), refresh=True) == "same"
    changed = [("a", 1, "md5:9"), ("c", 3, None)]
    with pytest.raises(PUB.ProvenanceChanged, match=r"added \(1\); checksum \(1\); license \(1\); removed \(1\)"):
        log.record(*frames(changed, "CC0-1.0"))
    assert {r["name"] for r in log.current()[1].collect()} == {"a", "b"}
    assert log.record(*frames(changed, "CC0-1.0"), refresh=True) == "refreshed"
    assert {r["name"] for r in log.current()[1].collect()} == {"a", "c"} and log.current()[0].first()["license"] == "CC0-1.0"
    assert PUB.latest(spark, log.path)[0] == 1
    more = spark.createDataFrame([("r", "CC0-1.0", "v1", "x"), ("s", "MIT", "v1", "x")], "record_id string, license string, version string, retrieved string")
    with pytest.raises(PUB.ProvenanceChanged, match="record added"):
        log.record(more, frames(changed)[1])


def test_a_version_without_its_pointer_does_not_count(spark):
    log = PUB.ProvenanceLog(spark, scratch_path(spark, "prov"))
    spark.range(3).write.parquet(f"{log.path}/version-lost/records")
    assert log.current() is None


def test_range_digests(spark, tmp_path):
    data = {"a.bin": bytes(range(256)) * 40, "short.bin": b"x" * 1000, "even.bin": b"y" * 2048}
    for name, raw in data.items():
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "empty.bin").write_bytes(b"")
    ranges = M.range_digests(spark, str(tmp_path), 1024)
    got = {(r["name"], r["part"]): (r["bytes"], r["md5"]) for r in ranges.collect()}
    assert got == {(n, k): (len(raw[k * 1024 : (k + 1) * 1024]), hashlib.md5(raw[k * 1024 : (k + 1) * 1024]).hexdigest()) for n, raw in data.items() for k in range(max(1, -(-len(raw) // 1024)))}
    whole = {r["name"]: r for r in M.range_roots(ranges).collect()}
    for n, raw in data.items():
        parts = "".join(got[n, k][1] for k in range(max(1, -(-len(raw) // 1024))))
        assert (whole[n]["size_bytes"], whole[n]["checksum"]) == (len(raw), f"ranges-1024:{hashlib.md5(parts.encode()).hexdigest()}" if len(raw) > 1024 else f"md5:{hashlib.md5(raw).hexdigest()}")
    recorded = spark.createDataFrame([tuple(r) for r in ranges.collect()], ranges.schema)
    (tmp_path / "a.bin").write_bytes(data["a.bin"][:5000] + b"!" + data["a.bin"][5001:])
    (tmp_path / "even.bin").write_bytes(data["even.bin"][:1500])
    (tmp_path / "short.bin").unlink()
    (tmp_path / "new.bin").write_bytes(b"n")
    bad = {(r["name"], r["part"]): r["status"] for r in M.verify_ranges(recorded, M.range_digests(spark, str(tmp_path), 1024)).filter("status != 'ok'").collect()}
    assert bad == {("a.bin", 4): "MISMATCH", ("even.bin", 1): "SHORT", ("short.bin", 0): "MISSING", ("new.bin", 0): "UNKNOWN"}
    with pytest.raises(ValueError):
        M.range_digests(spark, str(tmp_path), 0)
