"""URL filters by a sort-merge range join between urls and nested host and path rules.

A host is turned round label by label (``net?example?www?``), so a host with all its subdomains is one
interval of keys, and the paths that start with a rule's path are one interval below the host's key.
Hosts hold no ``?``, ``#`` or ``/``, which makes both separators safe. Urls and the ends of the rules'
intervals are sorted together; every end carries the stack of rules that are active behind it, and the
sweep hands the latest stack on to each url. One sweep over hosts yields the active nested hosts, then one
sweep for each level of nesting yields the innermost path rule of that host.

Urls are dealt to slices by a hash, so no host or url gathers in one task; each slice gets all interval ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pertmatrix.llm.common import ascii_lower, slices

_TOP = "struct<size:int,host_size:int,verdict:string,rule:string>"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _host_key(labels: Column) -> Column:
    return F.concat(F.concat_ws("?", labels), F.lit("?"))


def _behind(key: Column) -> Column:
    """A key behind all keys that start with ``key``: no UTF-8 text holds the byte FF."""
    return F.concat(key.cast("binary"), F.unhex(F.lit("FF")))


def _clean(rules: DataFrame) -> DataFrame:
    """One row per (host, path); of two verdicts for the same rule, block wins. Rules without a host fit nothing."""
    host = ascii_lower(F.col("host"))
    kept = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isin("allow", "block"))
    one = kept.select(host.alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    top = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), "verdict", F.concat("host", "path").alias("rule")
    )
    return one.select("host", "path", _host_key(_labels(F.col("host"))).alias("host_key"), top.cast(_TOP).alias("top"))


def _host_ends(rules: DataFrame) -> DataFrame:
    """Both ends of each rule host's interval, with the stack of rule hosts that are active behind the end."""
    hosts = rules.select("host", "host_key").distinct()
    labels = _labels(F.col("host"))
    outer = hosts.select("host_key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _host_key(F.slice(labels, 1, n)))).alias("outer_key"))
    stacks = (
        outer.join(hosts.select(F.col("host_key").alias("outer_key")), "outer_key")
        .groupBy("host_key").agg(F.array_sort(F.collect_list("outer_key")).alias("stack"))
    )
    start = stacks.select(F.col("host_key").cast("binary").alias("_key"), F.col("stack").alias("_stack"))
    end = stacks.select(_behind(F.col("host_key")).alias("_key"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("_stack"))
    return start.unionByName(end)


def _path_ends(rules: DataFrame) -> DataFrame:
    """Both ends of each rule's interval below its host, with the rule that is on top of the stack behind the end."""
    shorter = rules.where(F.length("path") > 0).select(
        "host_key", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.expr("path").substr(F.lit(1), n))).alias("outer_path")
    )
    outer = rules.select("host_key", F.col("path").alias("outer_path"), F.col("top").alias("outer_top"))
    below = shorter.join(outer, ["host_key", "outer_path"]).groupBy("host_key", "path").agg(F.max_by("outer_top", F.length("outer_path")).alias("outer_top"))
    nested = rules.join(below, ["host_key", "path"], "left")
    key = F.concat("host_key", F.lit("#"), "path")
    nothing = F.struct(F.lit(0), F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string")).cast(_TOP)
    start = nested.select(key.cast("binary").alias("_path_key"), F.col("top").alias("_top"))
    end = nested.select(_behind(key).alias("_path_key"), F.coalesce("outer_top", nothing).alias("_top"))
    return start.unionByName(end)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of ``pages``, repeated rows included.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the
    url's path starts with the rule's; of several, the one with the most characters wins, then the one with
    the longer host. Urls without a fitting rule get ``default`` and a null rule. Null urls, and urls without
    ``://``, have an empty host and path. Other columns of ``pages`` are not carried, so they cannot clash.
    Empty tables give empty results; without rules all urls get ``default``.
    """
    spark = pages.sparkSession
    n = slices(spark)
    rules = _clean(rules)
    depth = _host_ends(rules).agg(F.max(F.size("_stack"))).first()[0] or 0

    host, path = url_parts(F.col(url_col))
    urls = pages.select(
        F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"), F.pmod(F.xxhash64(id_col, url_col), F.lit(n)).cast("int").alias("_slice"), F.lit(1).alias("_kind")
    ).withColumn("_key", _host_key(_labels(F.col("_host"))).cast("binary"))
    ends = (
        _host_ends(rules).unionByName(_path_ends(rules), allowMissingColumns=True)
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_kind", F.lit(0))
    )

    def handed_on(col: str, key: str) -> Column:
        return F.last(col, ignorenulls=True).over(Window.partitionBy("_slice").orderBy(key, "_kind").rowsBetween(Window.unboundedPreceding, 0))

    swept = urls.unionByName(ends, allowMissingColumns=True).withColumn("_active", handed_on("_stack", "_key"))
    for level in range(depth):
        probe = F.concat(F.get("_active", F.lit(level)), F.lit("#"), F.col("_path")).cast("binary")
        swept = swept.withColumn(f"_at{level}", F.when(F.col("_kind") == 1, probe).otherwise(F.col("_path_key")))
        swept = swept.withColumn(f"_found{level}", F.when(F.col(f"_at{level}").isNotNull(), handed_on("_top", f"_at{level}")))
    found = [F.col(f"_found{level}") for level in range(depth)]
    best = (F.greatest(*found) if depth > 1 else found[0]) if depth else F.lit(None).cast(_TOP)
    return (
        swept.where(F.col("_kind") == 1).withColumn("_best", best)
        .select(
            F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"),
            F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
        )
    )
