"""The thirteen operators as registered queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pertmatrix.llm import bpe, chat_format, hamming, id_files, line_dedup, mixing, near_dup, quality, secrets, spelling, token_count, turn_repair, url_filter
from pertmatrix.llm.common import table, words
from pertmatrix.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: SQL for the words of a text and, in DuckDB's notation, for the six blanks.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_OP1 = r"""
WITH cut AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged"""


@query("op1_url_filter", _OP1)
def op1(spark, sf_dir):
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(verdict, host, path)")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op2_near_duplicates")
def op2(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query("op3_secret_scan")
def op3(spark, sf_dir):
    """Per document: its candidates, the secrets among them, and the digest of these, sorted, one a line."""
    found = secrets.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    kept = F.array_sort(F.transform(F.filter("findings", lambda x: x["secret"]), lambda x: x["value"]))
    return found.select(
        "doc_id", F.size("findings").cast("bigint").alias("n_candidates"), F.size(kept).cast("bigint").alias("n_secrets"),
        F.sha2(F.concat_ws("\n", kept), 256).alias("secrets_sha256"),
    )


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


_OP5 = """
WITH one AS (SELECT vec_id, min(embedding) AS embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
signs AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS s FROM one),
pairs AS (
  SELECT q.vec_id, r.vec_id AS neighbour_id, CAST(list_sum([abs(p[1] - p[2]) FOR p IN list_zip(q.s, r.s)]) AS INTEGER) AS distance
  FROM signs q JOIN signs r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT vec_id, neighbour_id, distance, rank FROM ranked WHERE rank <= 10"""


@query("op5_hamming_top_k", _OP5)
def op5(spark, sf_dir):
    """Ten nearest rows, by sign bits, to every row whose id is divisible by 20."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 20 = 0"), k=10)


_ESCAPED = r"length(regexp_extract_all(t, '[<\[]␛*(?:s>|/s>|\||INST\]|/INST\]|<SYS>>|</SYS>>)'))"
_OP6 = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(t) + {_ESCAPED} + length(role) + {_ESCAPED.replace("(t,", "(role,")} AS n FROM every)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST({len(chat_format.START)} + sum(n + {len(chat_format.TURN + chat_format.CONTENT + chat_format.END)}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op6_chat_format", _OP6)
def op6(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS own(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat_format.format_chat(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    read = made.withColumn("turns", chat_format.read_back(F.col("formatted"))).withColumn("loss", F.concat_ws("", chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op7_quality_rules")
def op7(spark, sf_dir):
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in base], F.round("_q_posterior", 6).alias("posterior"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_id_files")
def op9(spark, sf_dir):
    path = scratch_path(spark, "token-ids")
    id_files.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return id_files.read_ids(spark, path).select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


#: Sweeps of the fitting, power of the own shares that makes the targets, seed of the draws.
SWEEPS, POWER, SEED = 6, 0.9, 10


def _op10() -> str:
    dims = ("source", "lang", "topic")
    topic = """CASE WHEN contains(coalesce(text, ''), 'icense') THEN 'licensed' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
      WHEN length(coalesce(text, '')) >= 4000 THEN 'long prose' WHEN length(coalesce(text, '')) >= 1000 THEN 'prose' ELSE 'short prose' END"""
    steps = [
        f"placed AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, {topic} AS topic, len({_WORDS}) AS tokens FROM documents)",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS weight FROM placed GROUP BY ALL)",
        *[f"want_{d} AS (SELECT {d}, pow(sum(weight), {POWER}) AS share FROM cells GROUP BY {d})" for d in dims],
        "raked0 AS (SELECT *, weight AS raked FROM cells)",
    ]
    for k in range(SWEEPS * len(dims)):
        d = dims[k % len(dims)]
        steps.append(f"raked{k + 1} AS (SELECT r.* REPLACE (coalesce(raked * share / nullif(sum(raked) OVER (PARTITION BY {d}), 0), 0) AS raked) FROM raked{k} r JOIN want_{d} USING ({d}))")
    steps.append(f"need AS (SELECT *, raked / nullif(weight, 0) AS need FROM raked{SWEEPS * len(dims)})")
    steps.append("chance AS (SELECT source, lang, topic, coalesce(round(need / max(need) OVER (), 9), CASE WHEN weight = 0 THEN 1.0 ELSE 0.0 END) AS probability FROM need)")
    draw = f"(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 1000000000) / 1e9"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, CAST(tokens AS BIGINT) AS tokens, probability, {draw} < probability AS kept FROM placed JOIN chance USING (source, lang, topic)"


@query("op10_mixing", _op10())
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("own_source"), F.col("lang").alias("own_lang"))
    mixed = mix_documents(docs, F.col("own_source"), F.col("own_lang"))
    names = ("source", "lang", "topic", "tokens", "probability", "kept")
    return mixed.select("doc_id", *[F.col(f"_m_{n}").alias(n) for n in names])


def mix_documents(docs: DataFrame, source, lang) -> DataFrame:
    """The mixing of ``op10`` and of the pipeline: tokens are words, topics stand for what a text carries."""
    dims = {"source": source, "lang": lang, "topic": mixing.text_topic(F.col("text"))}
    return mixing.mix(docs, dims, F.size(words(F.col("text"))), power=POWER, seed=SEED, sweeps=SWEEPS)


#: SQL: CRC-32 of the column ``name`` of the table ``named`` as crc(name, h), byte by byte.
_CRC32 = """
crc_table AS (
  SELECT i, c FROM (
    WITH RECURSIVE t(i, k, c) AS (
      SELECT range, 0, range FROM range(256)
      UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t WHERE k < 8)
    SELECT i, c FROM t WHERE k = 8)),
crc_run(name, digits, k, c) AS (
  SELECT name, hex(encode(name)), 0, 4294967295::BIGINT FROM named
  UNION ALL
  SELECT name, digits, k + 1, xor(r.c >> 8, t.c) FROM crc_run r
  JOIN crc_table t ON t.i = xor(r.c & 255, CAST('0x' || substr(digits, 2 * k + 1, 2) AS BIGINT)) WHERE 2 * k < length(digits)),
crc AS (SELECT name, xor(c, 4294967295) AS h FROM crc_run WHERE 2 * k = length(digits))"""


def _op11() -> str:
    """Costs and audits are one string, the cost in nine digits, so the least string is the least (cost, audit)."""

    def add(value, cost, letter):
        return f"(lpad(CAST(CAST(substr({value}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({value}, 10) || '{letter}')"

    never = "'900000000'"
    kept = {s: f"CASE WHEN gone OR i <> '{s}' THEN {never} ELSE {{}} END" for s in "sua"}
    changed = {s: f"CASE WHEN gone OR i = '{s}' THEN {never} ELSE {{}} END" for s in "ua"}
    before_u = "least(e, s, a1)"
    return rf"""
WITH RECURSIVE named AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
{_CRC32},
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, h % 20 AS d
  FROM conversations JOIN crc ON name = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS initial,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS previous FROM placed),
faults AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
rec(conv_id, k, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '000000000', {never}, {never}, {never} FROM faults
  UNION ALL
  SELECT conv_id, k, {add("e", 3, "D")}, least({add("s", 3, "D")}, {kept["s"].format(add("e", "t", "K"))}),
         least({add("u1", 3, "D")}, {kept["u"].format(add(before_u, "t", "K"))}, {changed["u"].format(add(before_u, "2 + t", "R"))}),
         least({add("a1", 3, "D")}, {kept["a"].format(add("u1", "t", "K"))}, {changed["a"].format(add("u1", "2 + t", "R"))})
  FROM (SELECT *, least(a, {add("u1", 2, "I")}) AS a1
        FROM (SELECT r.conv_id, f.k, e, s, a, least(u, {add("e", 2, "I")}, {add("s", 2, "I")}, {add("a", 2, "I")}) AS u1,
                     f.initial AS i, f.fault IN ('blank', 'duplicate') AS gone, CASE WHEN f.fault = 'truncated' THEN 1 ELSE 0 END AS t
              FROM rec r JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.k = r.k + 1))),
last_rec AS (
  SELECT r.conv_id, least(e, a, {add(f"least(u, {add('e', 2, 'I')}, {add('s', 2, 'I')})", 2, "I")}) AS best
  FROM rec r JOIN faults f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.k),
audits AS (SELECT conv_id, CAST(substr(best, 1, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM last_rec),
edits AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS edit FROM audits WHERE audit <> ''),
spots AS (
  SELECT conv_id, p, edit, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS o
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
turned AS (
  SELECT q.conv_id, p, edit, o, f.role, f.text, max(CASE WHEN edit = 'K' AND o = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS led
  FROM spots q LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.k = q.k AND edit <> 'I' WHERE edit <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS lines
  FROM turned GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id"""


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by the CRC-32 of ``conv_id:turn``, nulls as one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = rows.where("_d <> 0").select("conv_id", "turn", F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "_d")
    return changed.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))).drop("_", "_d")


@query("op11_turn_repair", _op11())
def op11(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    repaired = turn_repair.repair_turns(damaged_turns(conversations))
    every = conversations.select("conv_id").distinct()
    verdicts, digests = repaired.verdicts.withColumnRenamed("conv", "_v"), repaired.digests().withColumnRenamed("conv", "_d")
    joined = every.join(verdicts, F.col("conv_id").eqNullSafe(F.col("_v")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The contract's misspelling and its least count of a word.
MISSPELT, SEEN = 199, 5

_OP12 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
named AS (SELECT DISTINCT name FROM counted),
{_CRC32},
spelt AS (
  SELECT CASE WHEN h % {MISSPELT} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
  FROM counted JOIN crc USING (name)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= {SEEN}),
holes AS (SELECT word, n, k, substr(word, 1, CAST(k AS BIGINT)) || substr(word, CAST(k AS BIGINT) + 2) AS rest FROM words, range(40) AS r(k) WHERE k < length(word)),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS top, max(other_n) AS top_n, any_value(n) AS n FROM pairs GROUP BY word),
judged AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * words.n THEN top END AS form, CASE WHEN top_n >= 5 * words.n THEN top_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
up(word, root, form) AS (SELECT word, word, form FROM judged UNION ALL SELECT up.word, up.form, j.form FROM up JOIN judged j ON j.word = up.form)
SELECT j.word, j.form, up.root, j.n, j.n_near, j.form_n FROM judged j JOIN up ON up.word = j.word AND up.form IS NULL"""


def misspelt(doc_id, run: str) -> str:
    """The contract's damage: one in 199 of the pairs of document and run loses a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % MISSPELT:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


@query("op12_spelling_variants", _OP12)
def op12(spark, sf_dir):
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), least_chars=6, respell=misspelt)
    return spelling.spelling_groups(counts.where(F.col("n") >= SEEN))


_OP13 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> top AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""


@query("op13_line_dedup", _OP13)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cut = line_dedup.without_lines(docs, line_dedup.line_bitmaps(docs, least_chars=20, least_docs=3))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
