"""Streams that fold their batches: bounded reading, replays, and bytes that follow the batch."""

import pytest
from pyspark.sql import functions as F

from pertmatrix.session import scratch_path
from pertmatrix.sources import published as PUB
from pertmatrix.streaming import incremental as I


def frame(spark, rows):
    return spark.createDataFrame(rows, I.PACKED_SCHEMA)


def cell(i, label, genes):
    return (i, label, [g for g, _ in genes], [float(v) for _, v in genes], 0)


def told(df):
    return {(r["target_gene"], r["gene_pos"]): (round(r["count_sum"], 6), round(r["cpm_sum"], 3)) for r in df.collect()}


@pytest.fixture(params=[I.run_running_sums, I.run_folded_sums])
def run(request):
    return request.param


def arrive(spark, path, rows):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(path)


def test_totals_of_many_batches_read_few_files(spark, run):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    rows = [cell(i, "AB"[i % 2], [(i % 3, 1 + i % 4), (5, 2)]) for i in range(11)]
    for r in rows:
        arrive(spark, path, [r])
    got = run(I.read_packed(spark, path), out, state, every=3)
    assert told(got) == told(I.sums(I.packed_entries(frame(spark, rows))))
    mark = PUB.latest(spark, out)[0]
    log = I.BatchLog(spark, out, I._added, 3)
    batches = spark.read.schema(f"{I.DELTA_SCHEMA}, batch_id bigint").parquet(f"{out}/batches")
    assert mark >= 6 and batches.select("batch_id").distinct().count() == 11
    assert log.rows().filter(F.col("batch_id") > mark).select("batch_id").distinct().count() <= 4
    arrive(spark, path, [cell(99, "C", [(0, 7)])])
    again = run(I.read_packed(spark, path), out, state, every=3)
    assert told(again) == told(I.sums(I.packed_entries(frame(spark, [*rows, cell(99, "C", [(0, 7)])]))))


def test_a_replayed_batch_counts_once(spark):
    out = scratch_path(spark, "log")
    log = I.BatchLog(spark, out, I._added, 2)
    parts = [I.sums(I.packed_entries(frame(spark, [cell(i, "A", [(0, i + 1)])]))) for i in range(6)]
    for i, p in enumerate(parts):
        log.write(p, i)
        log.write(p, i)  # the same batch once more, also after it has led to a new base
    assert told(log.read())["A", 0][0] == 21
    log.write(parts[1], 1)  # one that lies in the base already
    assert told(log.read())["A", 0][0] == 21
    assert PUB.latest(spark, out)[0] == 3


def test_a_base_without_its_pointer_does_not_count(spark):
    out = scratch_path(spark, "log")
    log = I.BatchLog(spark, out, I._added, 100)
    part = I.sums(I.packed_entries(frame(spark, [cell(0, "A", [(0, 4)])])))
    log.write(part, 0)
    part.write.parquet(f"{out}/base-lost")
    assert told(log.read())["A", 0][0] == 4
    log.compact(0)
    assert told(log.read())["A", 0][0] == 4 and log.rows().count() == 1


def test_running_sums_write_only_what_a_batch_changes(spark):
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    arrive(spark, path, [cell(i, f"L{i}", [(g, 1) for g in range(20)]) for i in range(30)])
    I.run_running_sums(I.read_packed(spark, path), out, state)
    arrive(spark, path, [cell(77, "L3", [(4, 6)])])
    got = told(I.run_running_sums(I.read_packed(spark, path), out, state))
    sizes = {r["batch_id"]: r["count"] for r in spark.read.parquet(f"{out}/batches").groupBy("batch_id").count().collect()}
    assert sizes == {0: 600, 1: 1} and got["L3", 4][0] == 7 and len(got) == 600
