"""Queries: scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.matrix import CONTROL, pack_rows, unpack_dense, unpack_rows
from pertmatrix.operators import cells as C, contract as K, emit, expression, pseudobulk as P, sampling as S
from pertmatrix.plans.registry import CELLS, EXPR, GENES, MATRIX, query, r6
from pertmatrix.session import scratch_path
from pertmatrix.sources import pages as PG, published, scans, sinks, testdata as T

CONTEXTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("scan_matrix", f"WITH {EXPR} SELECT * FROM expr")
def scan_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = sinks.write_matrix(T.count_matrix(spark, d), scratch_path(spark, "matrix"))
    return scans.scan_matrix(spark, path).expr


@query("scan_matrix_tables", f"""
WITH {CELLS}, {EXPR}, {GENES}
SELECT 'cell' AS part, CAST(cell_id AS VARCHAR) AS id, target_gene AS name, context AS other, CAST(NULL AS DOUBLE) AS value FROM cells
UNION ALL SELECT 'gene', CAST(gene_pos AS VARCHAR), gene, ensembl_id, NULL FROM genes
UNION ALL SELECT 'entry', CAST(cell_id AS VARCHAR), gene, NULL, value FROM expr""")
def scan_matrix_tables(spark: SparkSession, d: str) -> DataFrame:
    """All three tables of a matrix, written and read back."""
    return T.long_rows(scans.scan_matrix(spark, sinks.write_matrix(T.count_matrix(spark, d), scratch_path(spark, "matrix"))))


@query("scan_metadata_only", f"WITH {CELLS} SELECT cell_id, target_gene, context, batch FROM cells")
def scan_metadata_only(spark, d):
    path = scratch_path(spark, "matrix")
    T.cells(spark, d).write.parquet(f"{path}/cells")
    return scans.scan_metadata(spark, path).drop("cell_ord")


@query("scan_sparse_rows", f"WITH {EXPR}, {GENES} SELECT cell_id, gene_pos, value FROM expr JOIN genes USING (gene)")
def scan_sparse_rows(spark, d):
    return unpack_rows(pack_rows(T.count_matrix(spark, d)))


@query("scan_dense_rows", """
SELECT cell_id, gene_pos, value FROM (
  SELECT vec_id AS cell_id, unnest(range(len(embedding))) AS gene_pos, CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings) WHERE value <> 0""")
def scan_dense_rows(spark, d):
    return unpack_dense(T.table(spark, d, "embeddings"), "vec_id", "embedding")


HOLDOUT_SQL = """
  per_label AS (SELECT target_gene, count(*) AS n_cells FROM cells WHERE target_gene <> 'non-targeting' GROUP BY 1),
  hold AS (SELECT target_gene FROM per_label WHERE n_cells >= 30 ORDER BY md5('7:' || target_gene), target_gene LIMIT 8)"""


@query("scan_split", f"""
WITH {CELLS}, {HOLDOUT_SQL},
  sided AS (SELECT *, target_gene IN (SELECT target_gene FROM hold) AS held FROM cells)
SELECT 'all' AS split, target_gene, count(*) AS n_cells FROM sided GROUP BY 2
UNION ALL SELECT 'train', target_gene, count(*) FROM sided WHERE NOT held GROUP BY 2
UNION ALL SELECT 'holdout', target_gene, count(*) FROM sided WHERE held OR target_gene = 'non-targeting' GROUP BY 2""")
def scan_split(spark, d):
    cells = T.cells(spark, d)
    sides = S.carve_holdout(cells, 8, seed=7)

    def part(split: str) -> DataFrame:
        return S.count_labels(S.split_cells(cells, sides, split)).withColumn("split", F.lit(split))

    return part("all").unionByName(part("train")).unionByName(part("holdout"))


@query("scan_label_list", f"WITH {CELLS} SELECT DISTINCT target_gene FROM cells")
def scan_label_list(spark, d):
    path = scratch_path(spark, "labels")
    S.count_labels(T.cells(spark, d)).select("n_cells", "target_gene").write.csv(path, header=True)
    return scans.scan_label_list(spark, path)


@query("scan_gene_axis", f"""
WITH {GENES} SELECT CAST(h AS BOOLEAN) AS has_header, gene_pos, gene FROM genes, (VALUES (true), (false)) v(h)""")
def scan_gene_axis(spark, d):
    genes = T.genes(spark, d)
    n = genes.count()
    listed = genes.orderBy("gene_pos").select("gene").coalesce(1)
    out = None
    for header in (True, False):
        path = scratch_path(spark, "genes")
        listed.write.csv(path, header=header)
        axis, found = scans.scan_gene_axis(spark, path, n)
        part = axis.withColumn("has_header", F.lit(found))
        out = part if out is None else out.unionByName(part)
    return out


@query("scan_source_set", f"""
WITH {CELLS} SELECT context AS source, 'non-targeting' AS control_label, target_gene, count(*) AS n_cells
FROM cells GROUP BY 1, 3""")
def scan_source_set(spark, d):
    cells = T.cells(spark, d)
    merged, dims = scans.scan_source_set({c: (cells.filter(F.col("context") == c), CONTROL) for c in T.contexts(spark, d)})
    return merged.groupBy("source", "target_gene").agg(F.count("*").alias("n_cells")).join(dims, "source")


def host_responses(spark: SparkSession, d: str) -> DataFrame:
    """Saved API responses: one JSON text per record page of at most 1000 files."""
    files = T.host_files(spark, d).withColumn("page", F.concat_ws(":", "record_id", F.floor(F.col("name").cast("bigint") / 1000).cast("string")))
    one = F.struct(F.col("name").alias("key"), F.col("size_bytes").alias("size"), "checksum", F.struct(F.col("url").alias("self")).alias("links"))
    grouped = files.groupBy("page").agg(F.max("stated").alias("stated"), F.collect_list(one).alias("files"))
    meta = F.struct(F.col("page").alias("title"), F.lit("v1").alias("version"), F.when(F.col("stated").isNotNull(), F.struct(F.col("stated").alias("id"))).alias("license"))
    return grouped.select(F.to_json(F.struct(F.col("page").alias("id"), meta.alias("metadata"), "files")).alias("body"))


LICENSE_SQL = """CASE lang WHEN 'en' THEN 'CC-BY-4.0' WHEN 'es' THEN 'CC-BY-NC-SA-4.0' WHEN 'fr' THEN 'custom-terms' ELSE 'unknown' END"""
CHECKSUM_SQL = "CASE WHEN doc_id % 50 <> 0 THEN 'md5:' || md5(text) END"


@query("scan_host_record", f"""
SELECT source || ':' || lang || ':' || (doc_id // 1000) AS record_id, 'hostrecord' AS host, {LICENSE_SQL} AS license,
       CAST(doc_id AS VARCHAR) AS name, n_chars AS size_bytes, {CHECKSUM_SQL} AS checksum, 'https://host.example/' || doc_id AS url
FROM documents""")
def scan_host_record(spark, d):
    records, files = scans.scan_host_records(host_responses(spark, d), "hostrecord")
    return files.join(records.select("record_id", "host", "license"), "record_id")


def leaderboard_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with up to 50 customers as board entries, and the raw web pages, which carry no board."""
    c = T.table(spark, d, "customer").select(
        F.floor(F.col("c_custkey") / 50).cast("bigint").alias("page"), (F.col("c_custkey") % 3).alias("b"), "c_custkey", "c_name", "c_mktsegment", "c_acctbal"
    )
    entry = F.struct(
        F.col("c_custkey").alias("rank"), F.concat("c_name", F.lit(' "x]" \\ ü')).alias("teamName"),
        F.col("c_mktsegment").alias("modelName"), F.col("c_acctbal").alias("scoreAvg"),
    )
    boards = c.groupBy("page").agg(*[
        F.to_json(F.sort_array(F.collect_list(F.when(F.col("b") == i, entry)))).alias(f"e{i}") for i in range(3)
    ], *[F.count_if(F.col("b") == i).alias(f"n{i}") for i in range(3)])
    fields = []
    for i, (entries, total) in enumerate(PG.BOARD_KEYS.values()):
        fields += [F.lit(f'"{entries}":'), F.col(f"e{i}"), F.lit(f',"{total}":'), F.col(f"n{i}").cast("string"), F.lit("," if i < 2 else "")]
    payload = F.concat(F.lit('13:["$","div",null,{"children":["$","$L19",null,{'), *fields, F.lit("}]}]\n"))
    quoted = F.to_json(F.struct(payload.alias("p")))
    literal = F.substring(quoted, 7, F.length(quoted) - 8)
    html = F.concat(
        F.lit('<html><body><div>Loading...</div><script>self.__next_f.push([1,"0:[]"])</script><script>self.__next_f.push([1,"'),
        literal, F.lit('"])</script></body></html>'),
    )
    made = boards.select(F.concat(F.lit("b"), F.col("page").cast("string")).alias("page_id"), html.alias("html"))
    plain = T.table(spark, d, "pages").select(F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("page_id"), "html")
    return made.unionByName(plain)


ENTRIES_SQL = """
SELECT 'b' || (c_custkey // 50) AS page_id, CASE c_custkey % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'final' ELSE 'generalist' END AS board,
       count(*) OVER (PARTITION BY c_custkey // 50, c_custkey % 3) AS total,
       c_custkey AS rank, c_name || ' "x]" \\ ü' AS "teamName", c_mktsegment AS "modelName", c_acctbal AS "scoreAvg"
FROM customer"""


@query("scan_leaderboard_pages", ENTRIES_SQL)
def scan_leaderboard_pages(spark, d):
    rows = PG.board_rows(PG.board_entries(leaderboard_pages(spark, d)))
    return rows.select("page_id", "board", "total", "rank", "teamName", "modelName", "scoreAvg")


@query("scan_leaderboard_missing", "SELECT 'w' || page_id AS page_id FROM pages")
def scan_leaderboard_missing(spark, d):
    return PG.pages_without_boards(leaderboard_pages(spark, d))


WILCOXON_SQL = """
  lab AS (SELECT target_gene, count(*) AS n FROM cells GROUP BY 1),
  stored AS (SELECT target_gene, gene, value, count(*) AS k FROM entries GROUP BY 1, 2, 3),
  hist AS (SELECT * FROM stored UNION ALL
    SELECT target_gene, gene, 0.0, n - coalesce(k, 0) FROM lab CROSS JOIN genes
    LEFT JOIN (SELECT target_gene, gene, sum(k) AS k FROM stored GROUP BY 1, 2) USING (target_gene, gene)
    WHERE n - coalesce(k, 0) > 0),
  pooled AS (
    SELECT p.target_gene, g.gene, h.value, sum(CASE WHEN h.target_gene = p.target_gene THEN k ELSE 0 END) AS kp, sum(k) AS t
    FROM lab p CROSS JOIN genes g JOIN hist h ON h.gene = g.gene AND h.target_gene IN (p.target_gene, 'non-targeting')
    WHERE p.target_gene <> 'non-targeting' GROUP BY 1, 2, 3),
  ranked AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY target_gene, gene ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS midrank FROM pooled),
  ranksum AS (SELECT target_gene, gene, sum(kp * midrank) AS w, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM ranked GROUP BY 1, 2),
  tested AS (SELECT r.target_gene, gene, p.n AS n1, c.n AS n2, w - p.n * (p.n + 1) / 2.0 AS u, ties,
             CAST(p.n AS DOUBLE) * c.n / 12.0 * ((p.n + c.n + 1) - ties / (CAST(p.n + c.n AS DOUBLE) * (p.n + c.n - 1))) AS spread
             FROM ranksum r JOIN lab p ON p.target_gene = r.target_gene JOIN lab c ON c.target_gene = 'non-targeting'),
  de AS (SELECT target_gene, gene, n1 AS n_pert, n2 AS n_ctrl, u, CASE WHEN spread > 0 THEN (u - CAST(n1 AS DOUBLE) * n2 / 2.0) / sqrt(spread) ELSE 0 END AS z FROM tested)"""


@query("scan_de_cache", f"WITH {MATRIX}, {WILCOXON_SQL} SELECT target_gene, gene, round(z, 6) + 0.0 AS z FROM de")
def scan_de_cache(spark, d):
    m = T.count_matrix(spark, d)
    path = scratch_path(spark, "real-de")
    expression.wilcoxon(C.labelled(m), m.cells, m.genes).write.parquet(path)
    return scans.scan_saved(spark, path).select("target_gene", "gene", r6("z").alias("z"))


PB_SQL = """
  pb AS (SELECT target_gene, gene, sum(value) AS count_sum, sum(value / libsize * 1e6) AS cpm_sum,
                sum((value / libsize * 1e6) * (value / libsize * 1e6)) AS cpm_sq_sum FROM entries GROUP BY 1, 2),
  pl AS (SELECT target_gene, count(libsize) AS n_cells, coalesce(sum(libsize), 0) AS libsize_sum
         FROM cells LEFT JOIN lib USING (cell_id) GROUP BY 1)"""
PB_ROWS = """SELECT target_gene, gene, n_cells, libsize_sum, count_sum, round(cpm_sum / 1e6, 6) AS cpm_sum,
  round(cpm_sq_sum / 1e12, 6) AS cpm_sq_sum FROM pb JOIN pl USING (target_gene)"""


def pb_rows(pb: P.PseudobulkSums) -> DataFrame:
    return pb.gene.join(pb.label, list(pb.by)).select(
        *pb.by, "gene", "n_cells", "libsize_sum", "count_sum", r6("cpm_sum", 1e6).alias("cpm_sum"), r6("cpm_sq_sum", 1e12).alias("cpm_sq_sum")
    )


@query("sink_pseudobulk", f"WITH {MATRIX}, {PB_SQL} {PB_ROWS}")
def sink_pseudobulk(spark, d):
    path = sinks.write_pseudobulk(P.label_sums(T.count_matrix(spark, d)), scratch_path(spark, "pseudobulk"))
    return pb_rows(sinks.read_pseudobulk(spark, path))


CAP_SQL = """
  ranked AS (SELECT *, row_number() OVER (PARTITION BY target_gene ORDER BY md5('1:' || target_gene || ':' || cell_id), cell_id) AS k FROM cells),
  capped AS (SELECT * FROM ranked WHERE k <= CASE WHEN target_gene = 'non-targeting' THEN 200 ELSE 50 END)"""


@query("sink_subset", f"""
WITH {CELLS}, {EXPR}, {CAP_SQL}
SELECT target_gene, count(DISTINCT cell_id) AS n_cells, count(gene) AS n_entries, CAST(sum(value) AS BIGINT) AS total
FROM capped LEFT JOIN expr USING (cell_id) GROUP BY 1""")
def sink_subset(spark, d):
    m = T.count_matrix(spark, d)
    kept = S.cap_per_label(m.cells, 50, 200, seed=1)
    path = sinks.write_subset(kept, m.expr, scratch_path(spark, "subset"))
    return spark.read.parquet(path).groupBy("target_gene").agg(
        F.count_distinct("cell_id").alias("n_cells"), F.count("gene").alias("n_entries"), F.sum("value").cast("bigint").alias("total")
    )


PROFILE_SQL = """
  ctrl AS (SELECT * FROM entries WHERE target_gene = 'non-targeting'),
  prof AS (SELECT context, gene, cpm / sum(cpm) OVER (PARTITION BY context) AS fraction FROM (
             SELECT x.context, g.gene, coalesce(sum(value / libsize * 1e6), 0) AS cpm
             FROM (SELECT DISTINCT context FROM ctrl) x CROSS JOIN genes g LEFT JOIN ctrl e ON e.context = x.context AND e.gene = g.gene GROUP BY 1, 2) s),
  depth AS (SELECT context, median(libsize) AS depth FROM (SELECT DISTINCT context, cell_id, libsize FROM ctrl) c GROUP BY 1)"""


def null_emission(spark: SparkSession, d: str, cells_per_pert: int) -> tuple[K.Contract, DataFrame, DataFrame]:
    """Unshifted even cells for every (context, perturbation): contract, cells, entries."""
    m = C.rows_written(T.count_matrix(spark, d))
    perts = m.cells.filter(F.col("target_gene") != CONTROL).select("target_gene").distinct()
    contract = K.Contract(m.genes, perts, CONTEXTS, cells_per_pert)
    profile, libsizes = emit.context_profile(C.labelled(m), m.genes)
    grid = K.expected_blocks(contract)
    fractions = profile.join(grid, "context").select("context", "target_gene", "gene_pos", "gene", "fraction")
    totals = emit.even_totals(fractions, emit.median_depth(libsizes), grid.withColumn("n", F.lit(cells_per_pert).cast("bigint")))
    cell_id = F.concat_ws("/", "context", "target_gene", F.col("cell_no").cast("string"))
    entries = emit.allocate_even(totals, seed=3).select(cell_id.alias("cell_id"), "gene", "value")
    cells = S.explode_range(grid.withColumn("n", F.lit(cells_per_pert)), "n", "cell_no").select(cell_id.alias("cell_id"), "context", "target_gene")
    return contract, cells, entries


@query("sink_prediction", f"""
WITH {MATRIX}, {PROFILE_SQL},
  tot AS (SELECT context, p.target_gene, round_even(20 * depth * fraction, 0) AS t
          FROM prof JOIN depth USING (context) CROSS JOIN (SELECT DISTINCT target_gene FROM cells WHERE target_gene <> 'non-targeting') p)
SELECT context, target_gene, CAST(20 AS BIGINT) AS n_cells, CAST(sum(t) AS BIGINT) AS total,
       CAST(sum(CASE WHEN t >= 20 THEN 20 ELSE t END) AS BIGINT) AS nnz FROM tot GROUP BY 1, 2""")
def sink_prediction(spark, d):
    contract, cells, entries = null_emission(spark, d, 20)
    path = scratch_path(spark, "prediction")
    published.publish_prediction(contract, cells, entries, path)
    back = published.read_prediction(spark, path)
    return back.groupBy("context", "target_gene").agg(
        F.count("*").alias("n_cells"),
        F.sum(F.aggregate("val", F.lit(0.0), lambda a, v: a + v)).cast("bigint").alias("total"),
        F.sum(F.size("val")).alias("nnz"),
    )


@query("sink_reports", f"""
WITH {CELLS}, n AS (SELECT target_gene, count(*) AS n_cells FROM cells GROUP BY 1)
SELECT f AS format, target_gene, n_cells FROM n, (VALUES ('json'), ('csv')) v(f)""")
def sink_reports(spark, d):
    report = S.count_labels(T.cells(spark, d))
    schema = "target_gene string, n_cells bigint"
    json = spark.read.schema(schema).json(sinks.write_report(report, scratch_path(spark, "report"), "json"))
    csv = spark.read.schema(schema).csv(sinks.write_report(report, scratch_path(spark, "report"), "csv"), header=True)
    return json.withColumn("format", F.lit("json")).unionByName(csv.withColumn("format", F.lit("csv")))


@query("sink_provenance", f"""
SELECT source || ':' || lang || ':' || (doc_id // 1000) AS record_id, {LICENSE_SQL} AS license,
       CAST(doc_id AS VARCHAR) AS name, n_chars AS size_bytes, {CHECKSUM_SQL} AS checksum FROM documents""")
def sink_provenance(spark, d):
    records, files = scans.scan_host_records(host_responses(spark, d), "hostrecord")
    path = sinks.write_provenance(records, files, scratch_path(spark, "provenance"))
    kept = spark.read.parquet(f"{path}/files").join(spark.read.parquet(f"{path}/records"), "record_id")
    return kept.select("record_id", "license", "name", "size_bytes", "checksum")


@query("sink_leaderboard_snapshot", f"""
SELECT s AS fetched_utc, page_id, board, rank, "scoreAvg" FROM ({ENTRIES_SQL}) e, (VALUES ('20260821T0900Z'), ('20260822T0900Z')) v(s)""")
def sink_leaderboard_snapshot(spark, d):
    rows = PG.board_rows(PG.board_entries(leaderboard_pages(spark, d)))
    path = scratch_path(spark, "boards")
    for stamp in ("20260821T0900Z", "20260822T0900Z"):
        sinks.append_snapshot(rows, path, stamp)
    return spark.read.parquet(path).select("fetched_utc", "page_id", "board", "rank", "scoreAvg")
