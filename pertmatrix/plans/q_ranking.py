"""Queries: ranks, top-k, apportionment, predicted cells, set operations, contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pertmatrix.functions.hashing import seed_hash
from pertmatrix.matrix import CONTROL
from pertmatrix.operators import axis, cells as C, contract as K, effects as FX, emit, manifest as M, predictors as R, profile as PR, pseudobulk as P, ranking, sampling as S
from pertmatrix.plans.q_aggregates import POOLED, SOURCE_EFFECTS, logged_matrix, source_effects
from pertmatrix.plans.q_cells import DRAW_SQL, HELD_OUT, RUNG0B_SQL
from pertmatrix.plans.q_joins import CANDIDATES, PART_AXIS, TARGETS, part_axis, targets
from pertmatrix.plans.q_sources import CAP_SQL, CONTEXTS, ENTRIES_SQL, LICENSE_SQL, PROFILE_SQL, leaderboard_pages
from pertmatrix.plans.registry import CELLS, EXPR, GENES, MATRIX, MATRIX_LOG, query, r6
from pertmatrix.session import materialized, scratch_path
from pertmatrix.sources import pages as PG, published as PUB, scans, testdata as T


# -- ranks, top-k, order ---------------------------------------------------------------------


@query("rank_cap", f"WITH {CELLS}, {CAP_SQL} SELECT cell_id, target_gene, k AS rank FROM ranked")
def rank_cap(spark, d):
    cells = T.cells(spark, d)
    return ranking.shuffled_row_number(cells, ["target_gene"], seed_hash(1, "target_gene", "cell_id"), "cell_id").select("cell_id", "target_gene", "rank")


@query("topk_leaderboard", f"""
SELECT board, rank, "teamName", "scoreAvg", k AS rank_in_group FROM (
  SELECT *, row_number() OVER (PARTITION BY board ORDER BY "scoreAvg" DESC, rank) AS k FROM ({ENTRIES_SQL}) e) r WHERE k <= 20""")
def topk_leaderboard(spark, d):
    rows = PG.board_rows(PG.board_entries(leaderboard_pages(spark, d))).select("board", "rank", "teamName", "scoreAvg")
    return ranking.first_per_group(rows, ["board"], [F.desc("scoreAvg"), F.col("rank")], 20)


@query("topk_first_n_perts", """
SELECT s_suppkey AS pos, s_name AS target_gene FROM supplier ORDER BY s_suppkey LIMIT 7""")
def topk_first_n_perts(spark, d):
    listed = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("target_gene"))
    return scans.first_labels(listed, 7)


@query("topk_best_candidate", f"""
WITH {PART_AXIS}, {CANDIDATES} SELECT candidate, CAST(ord AS BIGINT) AS ord, valid_fraction FROM cand ORDER BY valid_fraction DESC, ord LIMIT 1""")
def topk_best_candidate(spark, d):
    return axis.best_candidate(axis.id_candidates(part_axis(spark, d), "ensembl_gene_id"))


@query("normalize_within_group", f"""
WITH {MATRIX}, s AS (SELECT target_gene, gene, sum(value) AS v FROM entries GROUP BY 1, 2)
SELECT target_gene, gene, round(v / sum(v) OVER (PARTITION BY target_gene), 6) AS share FROM s""")
def normalize_within_group(spark, d):
    pb = P.label_sums(T.count_matrix(spark, d)).gene
    return emit.normalize_within(pb, "count_sum", ["target_gene"], "share").select("target_gene", "gene", r6("share").alias("share"))


@query("sort_groups", f"WITH {CELLS} SELECT context, target_gene, count(*) AS n_cells FROM cells GROUP BY 1, 2 ORDER BY 1, 2")
def sort_groups(spark, d):
    return P.group_sizes(T.cells(spark, d), ["context", "target_gene"]).orderBy("context", "target_gene")


EVEN_SQL = f"""
  req AS (SELECT context, target_gene, count(*) AS n FROM cells WHERE target_gene <> 'non-targeting' GROUP BY 1, 2),
  frac AS (SELECT context, target_gene, gene, x / sum(x) OVER (PARTITION BY context, target_gene) AS fraction
           FROM (SELECT context, target_gene, gene, fraction * power(2, coalesce(pooled, 0)) AS x
                 FROM prof JOIN (SELECT DISTINCT context, target_gene FROM req) q USING (context) LEFT JOIN pooled USING (target_gene, gene)) m),
  tot AS (SELECT context, target_gene, gene, n, CAST(round_even(n * depth * fraction, 0) AS BIGINT) AS total,
            CAST('0x' || substr(md5('11:' || context || ':' || target_gene || ':' || gene), 1, 15) AS BIGINT) % n AS first,
            CAST({list(emit.STEPS)}[1 + CAST('0x' || substr(md5('11:' || context || ':' || target_gene || ':' || gene), 16, 1) AS BIGINT)] AS BIGINT) AS step
          FROM frac JOIN req USING (context, target_gene) JOIN depth USING (context)),
  spread AS (SELECT context, target_gene, gene, (j * step + first) % n AS cell_no, CAST(total // n + CASE WHEN j < total % n THEN 1 ELSE 0 END AS DOUBLE) AS value
             FROM (SELECT *, unnest(range(CASE WHEN total >= n THEN n ELSE total % n END)) AS j FROM tot) t)"""


def shifted_totals(spark, d) -> DataFrame:
    """As many cells as the real data hold for every (context, label), shifted by pooled effects."""
    m, effects = source_effects(spark, d, again=True)
    requests = m.cells.filter(F.col("target_gene") != CONTROL).groupBy("context", "target_gene").agg(F.count("*").alias("n"))
    shifts = FX.pooled_for_targets(requests.select("target_gene"), effects, m.genes).withColumnRenamed("pooled", "shift")
    profile, libsizes = emit.context_profile(C.labelled(m), m.genes)
    return emit.even_totals(emit.shift_fraction(profile, shifts), emit.median_depth(libsizes), requests)


@query("allocate_even", f"WITH {MATRIX}, {PROFILE_SQL}, {SOURCE_EFFECTS}, {POOLED}, {EVEN_SQL} SELECT * FROM spread")
def allocate_even(spark, d):
    return emit.allocate_even(shifted_totals(spark, d), seed=11).select("context", "target_gene", "gene", "cell_no", "value")


# The shift is amplified so that zeros of some genes are lifted over the floor.
PREDICTED = f"""
  shift AS (SELECT gene, gene_pos, CASE WHEN gene_pos % 4 = 0 THEN 1.5 ELSE 40 * delta END AS delta FROM rung0b),
  f AS (SELECT min(value) AS lowest FROM logged WHERE target_gene = 'non-targeting' AND value > 0),
  grid AS (SELECT d.target_gene, cell_no, gene_pos, gene, greatest(coalesce(value, 0) + delta, 0) AS v
           FROM draws d JOIN pool USING (pool_idx) CROSS JOIN shift LEFT JOIN logged USING (cell_id, gene))"""


@query("apply_delta_cells", f"""
WITH {MATRIX_LOG}, {RUNG0B_SQL}, {DRAW_SQL}, {PREDICTED}
SELECT target_gene, cell_no, gene_pos, gene, round(v, 6) + 0.0 AS value FROM grid, f WHERE v >= lowest""")
def apply_delta_cells(spark, d):
    m, logged = logged_matrix(spark, d)
    requests = S.count_labels(m.cells).filter(F.col("target_gene") != CONTROL).withColumnRenamed("n_cells", "n")
    shift = F.when(F.col("gene_pos") % 4 == 0, F.lit(1.5)).otherwise(40 * F.col("delta"))
    deltas = R.same_delta_for(requests, R.mean_perturbation_delta(P.label_moments(logged, m.cells, m.genes)).withColumn("delta", shift))
    return R.predict_cells(requests, deltas, logged, m.cells, m.genes).withColumn("value", r6("value"))


@query("rung_zero_delta", f"WITH {GENES}, {TARGETS} SELECT target_gene, gene_pos, gene, 0.0 AS delta FROM targets CROSS JOIN genes")
def rung_zero_delta(spark, d):
    return R.zero_delta(targets(spark, d), T.genes(spark, d))


# -- set operations --------------------------------------------------------------------------


@query("union_attach_controls", f"""
WITH {MATRIX}
SELECT 'pred_' || cell_id AS cell_id, target_gene, gene, value FROM entries WHERE context <> '1-URGENT' AND target_gene <> 'non-targeting'
UNION ALL SELECT 'ctrl_' || cell_id, target_gene, gene, value FROM entries WHERE context = '1-URGENT' AND target_gene = 'non-targeting'""")
def union_attach_controls(spark, d):
    m = T.count_matrix(spark, d)
    held = F.col("context") == HELD_OUT
    pred = m.cells.filter(~held & (F.col("target_gene") != CONTROL))
    own = m.expr.join(pred.select("cell_id"), "cell_id", "left_semi")
    axis.require_same_axis(m.genes, T.genes(spark, d))
    cells, entries = K.attach_controls(pred, own, m.cells.filter(held), m.expr)
    return entries.join(cells, "cell_id").select("cell_id", "target_gene", "gene", "value")


@query("union_labels", f"""
WITH {CELLS}, {TARGETS} SELECT target_gene FROM cells UNION SELECT target_gene FROM targets""")
def union_labels(spark, d):
    return T.cells(spark, d).select("target_gene").union(targets(spark, d)).distinct()


@query("except_axis_check", f"""
WITH a AS (SELECT p_partkey AS gene_pos, p_name AS gene FROM part),
  b AS (SELECT gene_pos, CASE WHEN gene_pos % 50 = 0 THEN gene || '*' ELSE gene END AS gene FROM a WHERE gene_pos <> 7)
SELECT gene_pos, a.gene AS gene_a, b.gene AS gene_b FROM a FULL JOIN b USING (gene_pos) WHERE a.gene IS DISTINCT FROM b.gene""")
def except_axis_check(spark, d):
    a = T.table(spark, d, "part").select(F.col("p_partkey").alias("gene_pos"), F.col("p_name").alias("gene"))
    b = a.filter("gene_pos != 7").withColumn(
        "gene", F.when(F.col("gene_pos") % 50 == 0, F.concat("gene", F.lit("*"))).otherwise(F.col("gene"))
    )
    return axis.axis_differences(a, b)


@query("intersect_labels", f"WITH {CELLS}, {TARGETS} SELECT target_gene FROM cells INTERSECT SELECT target_gene FROM targets")
def intersect_labels(spark, d):
    return PR.shared_labels(T.cells(spark, d).select("target_gene"), targets(spark, d))


# -- contract --------------------------------------------------------------------------------


@query("validate_contract", f"""
WITH {CELLS}, g AS (SELECT p_brand AS gene FROM part), p AS (SELECT DISTINCT target_gene FROM cells)
SELECT 'duplicate gene' AS rule, count(*) AS n FROM (SELECT gene FROM g GROUP BY 1 HAVING count(*) > 1) x
UNION ALL SELECT 'control listed as perturbation', count(*) FROM p WHERE target_gene = 'non-targeting'
UNION ALL SELECT 'contract exceeds the cell cap', count(*) * 5 * 4000 FROM p""")
def validate_contract(spark, d):
    genes = T.table(spark, d, "part").select(F.col("p_partkey").alias("gene_pos"), F.col("p_brand").alias("gene"))
    perts = T.cells(spark, d).select("target_gene").distinct()
    return K.contract_violations(K.Contract(genes, perts, CONTEXTS, cells_per_pert=4000))


def flawed_prediction(spark, d) -> tuple[K.Contract, DataFrame, DataFrame]:
    """The count matrix as a prediction with planted flaws: bad values, an unlisted context and label."""
    m = T.count_matrix(spark, d)
    perts = m.cells.filter(~F.col("target_gene").isin(CONTROL, "Brand#9")).select("target_gene").distinct()
    k = F.col("cell_id")
    value = (
        F.when(k % 211 == 0, -F.col("value")).when(k % 223 == 0, F.col("value") + 0.5).when(k % 227 == 0, F.lit(float("nan")))
        .when(k % 229 == 0, F.col("value") * 1e9).when(k % 233 == 0, F.lit(0.0)).otherwise(F.col("value"))
    )
    contract = K.Contract(m.genes, perts, CONTEXTS[:4], cells_per_pert=110, max_cells=1000)
    return contract, m.cells, m.expr.withColumn("value", value)


FLAWED = """
  flawed AS (SELECT cell_id, gene, CASE WHEN cell_id % 211 = 0 THEN -value WHEN cell_id % 223 = 0 THEN value + 0.5 WHEN cell_id % 227 = 0 THEN 'NaN'::DOUBLE
             WHEN cell_id % 229 = 0 THEN value * 1e9 WHEN cell_id % 233 = 0 THEN 0 ELSE value END AS value FROM expr)"""


@query("validate_block_values", f"""
WITH {CELLS}, {EXPR}, {FLAWED}, v AS (
  SELECT 'negative values' AS rule, count(*) AS n FROM flawed WHERE value < 0
  UNION ALL SELECT 'non-finite values', count(*) FROM flawed WHERE isnan(value)
  UNION ALL SELECT 'fractional values', count(*) FROM flawed WHERE NOT isnan(value) AND value >= 0 AND value <> round(value)
  UNION ALL SELECT 'cell total over the cap', count(*) FROM (SELECT cell_id FROM flawed WHERE NOT isnan(value) GROUP BY 1 HAVING sum(value) > 1000000) t
  UNION ALL SELECT 'unknown context', count(*) FROM cells WHERE context = '5-LOW'
  UNION ALL SELECT 'unknown perturbation', count(*) FROM cells WHERE target_gene IN ('non-targeting', 'Brand#9')
  UNION ALL SELECT 'cell cap exceeded', count(*) FROM cells HAVING count(*) > 1000)
SELECT rule, n FROM v WHERE n > 0""")
def validate_block_values(spark, d):
    contract, cells, entries = flawed_prediction(spark, d)
    return K.value_violations(contract, cells, entries, T.cell_tasks(spark, d))


BLOCK_SQL = """
  grid AS (SELECT c.context, p.target_gene FROM (SELECT DISTINCT context FROM cells WHERE context <> '5-LOW') c
           CROSS JOIN (SELECT DISTINCT target_gene FROM cells WHERE target_gene NOT IN ('non-targeting', 'Brand#9')) p),
  blocks AS (SELECT context, target_gene, count(*) AS n FROM cells GROUP BY 1, 2),
  probs AS (SELECT CASE WHEN g.context IS NULL THEN 'unexpected block' WHEN n IS NULL THEN 'missing block' ELSE 'wrong count block' END AS rule
            FROM blocks b FULL JOIN grid g ON g.context = b.context AND g.target_gene = b.target_gene
            WHERE g.context IS NULL OR n IS NULL OR n <> 110)"""


@query("validate_completeness", f"""
WITH {CELLS}, {BLOCK_SQL}
SELECT rule, count(*) AS n FROM probs GROUP BY 1
UNION ALL SELECT 'control rows present', count(*) FROM cells WHERE target_gene = 'non-targeting'""")
def validate_completeness(spark, d):
    contract, cells, _ = flawed_prediction(spark, d)
    return K.completeness_violations(contract, cells)


@query("write_summary", f"""
WITH {CELLS}, {EXPR}, pc AS (SELECT c.cell_id, coalesce(sum(value), 0) AS total, count(value) AS nnz FROM cells c LEFT JOIN expr USING (cell_id) GROUP BY 1)
SELECT count(*) AS n_cells, CAST(sum(nnz) AS BIGINT) AS nnz, max(total) AS max_row_total, median(nnz) AS median_nnz FROM pc""")
def write_summary(spark, d):
    m = T.count_matrix(spark, d)
    return K.write_summary(m.cells, m.expr)


# -- manifests -------------------------------------------------------------------------------

REC_SQL = f"""
  files AS (SELECT source || ':' || lang AS record_id, CAST(doc_id AS VARCHAR) AS name, n_chars AS size_bytes,
              CASE WHEN doc_id % 50 <> 0 THEN 'md5:' || md5(text) END AS checksum, {LICENSE_SQL} AS license, doc_id FROM documents),
  records AS (SELECT record_id, any_value(license) AS license FROM files GROUP BY 1)"""


def host_records(spark, d) -> DataFrame:
    stated = T.host_files(spark, d).groupBy("record_id").agg(F.max("stated").alias("stated"))
    return stated.select("record_id", M.spdx(F.col("stated")).alias("license"), F.lit("v1").alias("version"))


@query("manifest_gate", f"""
WITH {REC_SQL}, wanted AS (SELECT record_id, CASE WHEN doc_id % 211 = 0 THEN 'gone-' || name ELSE name END AS name FROM files),
  s AS (SELECT record_id, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (checksum IS NULL) AS n_unchecked FROM files SEMI JOIN wanted USING (record_id, name) GROUP BY 1),
  a AS (SELECT record_id, count(*) AS n_absent FROM wanted ANTI JOIN files USING (record_id, name) GROUP BY 1)
SELECT record_id, coalesce(n_files, 0) AS n_files, coalesce(size_bytes, 0) AS size_bytes, coalesce(n_unchecked, 0) AS n_unchecked,
  CASE WHEN n_absent > 0 THEN 'unknown file name' WHEN n_files IS NULL THEN 'no files' WHEN license = 'unknown' THEN 'no license'
       WHEN size_bytes > 40000 THEN 'over budget' WHEN n_unchecked > 0 THEN 'missing checksum' ELSE 'ok' END AS reason
FROM records LEFT JOIN s USING (record_id) LEFT JOIN a USING (record_id)""")
def manifest_gate(spark, d):
    files = T.host_files(spark, d)
    gone = F.when(F.col("name").cast("bigint") % 211 == 0, F.concat(F.lit("gone-"), "name")).otherwise(F.col("name"))
    records = host_records(spark, d).withColumn("budget_bytes", F.lit(40000))
    return M.gate(records, files, wanted=files.select("record_id", gone.alias("name")))


@query("license_drift", f"""
WITH {REC_SQL} SELECT record_id, 'CC-BY-4.0' AS declared, license AS observed FROM records WHERE license <> 'CC-BY-4.0'""")
def license_drift(spark, d):
    records = host_records(spark, d)
    return M.license_drift(records.withColumn("license", F.lit("CC-BY-4.0")), records)


@query("provenance_record_drift", f"""
WITH {REC_SQL}
SELECT record_id, 'license' AS field, license AS before, 'MIT' AS after FROM records WHERE record_id LIKE 'src1:%' AND license <> 'MIT'
UNION ALL SELECT record_id, 'version', 'v1', 'v2' FROM records WHERE record_id LIKE 'src2%'""")
def provenance_record_drift(spark, d):
    was = host_records(spark, d)
    now = was.withColumn("license", F.when(F.col("record_id").startswith("src1:"), "MIT").otherwise(F.col("license"))).withColumn(
        "version", F.when(F.col("record_id").startswith("src2"), F.lit("v2")).otherwise(F.col("version"))
    )
    return M.record_diff(was, now)


@query("verify_files", """
SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN doc_id % 89 = 0 THEN 'MISSING' WHEN doc_id % 97 = 0 THEN 'SHORT'
  WHEN doc_id % 31 = 0 THEN 'MISMATCH' WHEN doc_id % 50 = 0 THEN 'no-md5' ELSE 'ok' END AS status
FROM documents""")
def verify_files(spark, d):
    """Documents stand for the stored files: their bytes are hashed where the table lies."""
    docs = T.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("name"), F.octet_length("text").cast("bigint").alias("length"), F.md5("text").alias("found_md5"), "doc_id"
    )
    manifest = docs.select(
        "name", F.when(F.col("doc_id") % 97 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("size_bytes"),
        F.when(F.col("doc_id") % 31 == 0, F.lit("md5:0")).when(F.col("doc_id") % 50 != 0, F.concat(F.lit("md5:"), "found_md5")).alias("checksum"),
    )
    return M.verify_files(manifest, docs.filter(F.col("doc_id") % 89 != 0).drop("doc_id"))


#: Files that documents are written to, bytes of a range, and the files that are damaged afterwards.
FILES, RANGE, CHANGED, CUT, LOST = 16, 4096, 3, 5, 7


@query("verify_file_ranges", f"""
WITH lines AS (SELECT doc_id % {FILES} AS f, octet_length(encode(text)) + 1 AS b, row_number() OVER (PARTITION BY doc_id % {FILES} ORDER BY doc_id DESC) AS back FROM documents),
  sizes AS (SELECT f, CAST(sum(b) AS BIGINT) AS size_bytes, CAST(coalesce(sum(b) FILTER (back > 1), 0) AS BIGINT) AS short_bytes FROM lines GROUP BY f),
  n AS (SELECT *, CAST(ceil(size_bytes / {RANGE}.0) AS BIGINT) AS n_ranges, CAST(short_bytes // {RANGE} AS BIGINT) AS whole, CAST(ceil(short_bytes / {RANGE}.0) AS BIGINT) AS left_ranges FROM sizes)
SELECT 'file-' || f AS name, n_ranges, CASE f WHEN {CHANGED} THEN n_ranges - 1 WHEN {CUT} THEN whole WHEN {LOST} THEN 0 ELSE n_ranges END AS n_ok,
  CASE f WHEN {CHANGED} THEN 1 ELSE 0 END AS n_mismatch, CASE f WHEN {CUT} THEN left_ranges - whole ELSE 0 END AS n_short,
  CASE f WHEN {CUT} THEN n_ranges - left_ranges WHEN {LOST} THEN n_ranges ELSE 0 END AS n_missing FROM n""")
def verify_file_ranges(spark, d):
    """Documents are written to files and recorded by ranges; one file's first byte changes, one loses its last text, one is gone."""
    docs = T.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("file-"), (F.col("doc_id") % FILES).cast("string")).alias("name"))
    first, last = (docs.groupBy("name").agg(f("doc_id").alias("doc_id")) for f in (F.min, F.max))

    def written(rows: DataFrame, label: str) -> DataFrame:
        """One file for each name, its texts a line each in order."""
        path = scratch_path(spark, label)
        rows.repartition("name").sortWithinPartitions("name", "doc_id").select("name", "text").write.partitionBy("name").text(path)
        ranges = M.range_digests(spark, path, RANGE, recursive=True)
        return ranges.withColumn("name", F.regexp_extract("name", r"name=(file-\d+)/", 1))

    changed = docs.join(first.filter(f"name = 'file-{CHANGED}'").withColumn("_x", F.lit(True)), ["name", "doc_id"], "left")
    changed = changed.withColumn("text", F.when(F.col("_x"), F.concat(F.lit("\u0001"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))).drop("_x")
    damaged = changed.join(last.filter(f"name = 'file-{CUT}'"), ["name", "doc_id"], "left_anti").filter(f"name != 'file-{LOST}'")
    checked = M.verify_ranges(materialized(written(docs, "files"), "ranges"), written(damaged, "damaged"))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("ok", "MISMATCH", "SHORT", "MISSING")]
    return checked.groupBy("name").agg(F.count("*").alias("n_ranges"), *counts)


@query("provenance_versions", f"""
WITH {REC_SQL}, c AS (SELECT count(*) FILTER (doc_id % 89 = 0) + count(*) FILTER (doc_id % 89 <> 0 AND doc_id % 97 = 0) AS n FROM files)
SELECT * FROM (SELECT 'first' AS step, 'written' AS outcome, 0 AS version, 0 AS n_changes
  UNION ALL SELECT 'same again', 'same', 0, 0 UNION ALL SELECT 'another date', 'same', 0, 0
  UNION ALL SELECT 'changed', 'refused', 0, n FROM c UNION ALL SELECT 'refresh', 'refreshed', 1, n FROM c) steps""")
def provenance_versions(spark, d):
    """The manifest of the documents as a log: written, written again, with another date, with changed files, refreshed."""
    records, files = host_records(spark, d).withColumn("retrieved", F.lit("2026-08-21")), T.host_files(spark, d)
    later = records.withColumn("retrieved", F.lit("2026-08-22"))
    n = F.col("name").cast("bigint")
    changed = files.filter(n % 89 != 0).withColumn("size_bytes", F.when(n % 97 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    log = PUB.ProvenanceLog(spark, scratch_path(spark, "provenance-log"))
    steps = []
    for step, now, current, refresh in (
        ("first", records, files, False), ("same again", records, files, False), ("another date", later, files, False), ("changed", later, changed, False), ("refresh", later, changed, True),
    ):
        n_changes = 0 if log.current() is None else log.changes(now, current).count()
        try:
            outcome = log.record(now, current, refresh=refresh)
        except PUB.ProvenanceChanged:
            outcome = "refused"
        steps.append((step, outcome, PUB.latest(spark, log.path)[0], n_changes))
    return spark.createDataFrame(steps, "step string, outcome string, version int, n_changes bigint")
