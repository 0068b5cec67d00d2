"""Host manifests: licences, the admission gate, provenance drift, file verification."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

# Stated licence ids and their SPDX names, and the groups with further terms.
SPDX = {
    "cc-by-4.0": "CC-BY-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0",
    "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0",
    "cc0-1.0": "CC0-1.0",
    "mit": "MIT",
    "apache-2.0": "Apache-2.0",
}
REDISTRIBUTION_ENCUMBERED = ("CC-BY-SA-4.0", "CC-BY-NC-SA-4.0")
NONCOMMERCIAL = ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0")


def spdx(stated: Column) -> Column:
    """SPDX name of a stated licence; other terms as stated; 'unknown' when there are none."""
    names = F.create_map(*[F.lit(x) for pair in SPDX.items() for x in pair])
    own = F.when(F.length(stated) > 0, stated)
    return F.coalesce(names[F.lower(stated)], own, F.lit("unknown"))


def license_flags(records: DataFrame) -> DataFrame:
    return records.withColumn("noncommercial", F.col("license").isin(*NONCOMMERCIAL)).withColumn(
        "redistribution_encumbered", F.col("license").isin(*REDISTRIBUTION_ENCUMBERED)
    )


def to_provenance(records: DataFrame) -> DataFrame:
    """source, accession, license, retrieved: what a corpus carries, with the observed licence."""
    return records.select(
        F.col("host").alias("source"), F.col("record_id").alias("accession"), "license", "retrieved"
    )


def missing_names(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """record_id, name that were asked for and that the record does not have."""
    return wanted.select("record_id", "name").join(files.select("record_id", "name"), ["record_id", "name"], "left_anti")


def gate(
    records: DataFrame, files: DataFrame, *, wanted: DataFrame | None = None, allow_missing_checksum: bool = False
) -> DataFrame:
    """record_id, n_files, size_bytes, n_unchecked, reason: why a record may not be fetched, or 'ok'.

    ``records``: record_id, license, budget_bytes. ``files``: record_id, name, size_bytes, checksum.
    The budget applies to the selection; a selection exactly on budget passes. The first rule
    that refuses is the reason.
    """
    chosen = files if wanted is None else files.join(wanted.select("record_id", "name"), ["record_id", "name"], "left_semi")
    sums = chosen.groupBy("record_id").agg(
        F.count("*").alias("n_files"), F.sum("size_bytes").alias("size_bytes"),
        F.count_if(F.coalesce("checksum", F.lit("")) == "").alias("n_unchecked"),
    )
    rows = records.join(sums, "record_id", "left").fillna({"n_files": 0, "size_bytes": 0, "n_unchecked": 0})
    reason = F.when(F.col("n_files") == 0, "no files")
    if wanted is not None:
        absent = missing_names(files, wanted).groupBy("record_id").agg(F.count("*").alias("n_absent"))
        rows = rows.join(absent, "record_id", "left").fillna({"n_absent": 0})
        reason = F.when(F.col("n_absent") > 0, "unknown file name").when(F.col("n_files") == 0, "no files")
    reason = reason.when(F.coalesce("license", F.lit("")).isin("", "unknown"), "no license").when(
        F.col("size_bytes") > F.col("budget_bytes"), "over budget"
    )
    if not allow_missing_checksum:
        reason = reason.when(F.col("n_unchecked") > 0, "missing checksum")
    return rows.select("record_id", "n_files", "size_bytes", "n_unchecked", reason.otherwise("ok").alias("reason"))


def license_drift(declared: DataFrame, records: DataFrame) -> DataFrame:
    """record_id, declared, observed where the declared licence is stated and is not the observed one."""
    both = declared.select("record_id", F.col("license").alias("declared")).join(
        records.select("record_id", F.col("license").alias("observed")), "record_id"
    )
    return both.filter((F.col("declared") != "") & (F.col("declared") != F.col("observed")))


def manifest_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """record_id, name, change: removed, added, size or checksum; a file can have two changes."""
    keys = ["record_id", "name"]
    was = recorded.select(*keys, F.lit(True).alias("_was"), F.col("size_bytes").alias("s0"), F.col("checksum").alias("c0"))
    now = current.select(*keys, F.lit(True).alias("_now"), F.col("size_bytes").alias("s1"), F.col("checksum").alias("c1"))
    both = F.col("_was").isNotNull() & F.col("_now").isNotNull()
    changes = F.array_compact(F.array(
        F.when(F.col("_now").isNull(), "removed"),
        F.when(F.col("_was").isNull(), "added"),
        F.when(both & ~F.col("s0").eqNullSafe(F.col("s1")), "size"),
        F.when(both & ~F.col("c0").eqNullSafe(F.col("c1")), "checksum"),
    ))
    return was.join(now, keys, "full").select(*keys, F.explode(changes).alias("change"))


def record_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """record_id, field, before, after for licence and version. The retrieval date is not compared."""
    was = recorded.select("record_id", F.col("license").alias("l0"), F.col("version").alias("v0"))
    now = current.select("record_id", F.col("license").alias("l1"), F.col("version").alias("v1"))
    pair = lambda name, a, b: F.struct(F.lit(name).alias("field"), F.col(a).alias("before"), F.col(b).alias("after"))
    rows = was.join(now, "record_id").select("record_id", F.inline(F.array(pair("license", "l0", "l1"), pair("version", "v0", "v1"))))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def _md5_by_path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checksum files chunk by chunk where they lie; a file is never held whole."""
    import hashlib

    from pyarrow import fs

    for pdf in batches:
        sums = []
        for uri in pdf["path"]:
            if uri.startswith("file:/") and not uri.startswith("file://"):
                uri = "file://" + uri[len("file:"):]
            store, path = fs.FileSystem.from_uri(uri)
            digest = hashlib.md5()
            with store.open_input_stream(path) as stream:
                while block := stream.read(1 << 20):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield pdf.assign(found_md5=sums)


def found_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """name, length, found_md5 of the files in a folder.

    Files are listed without their content and streamed by the task that gets their path, whatever their size.
    """
    listed = spark.read.format("binaryFile").load(folder).select("path", "length")
    hashed = listed.repartition("path").mapInPandas(_md5_by_path, "path string, length bigint, found_md5 string")
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    name = F.regexp_replace(base, f"{suffix}$", "") if suffix else base
    return hashed.select(name.alias("name"), "length", "found_md5")


def verify_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """name, status for (name, size_bytes, checksum): MISSING, SHORT, no-md5, MISMATCH or ok."""
    want = F.element_at(F.split("checksum", ":"), -1)
    status = (
        F.when(F.col("length").isNull(), "MISSING")
        .when(F.col("length") != F.col("size_bytes"), "SHORT")
        .when(F.coalesce("checksum", F.lit("")) == "", "no-md5")
        .when(F.col("found_md5") != want, "MISMATCH")
        .otherwise("ok")
    )
    return manifest.join(found, "name", "left").select("name", status.alias("status"))


#: Bytes of a file that one row of a ranged digest stands for.
RANGE_BYTES = 64 << 20


def _local_uri(uri: str) -> str:
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _md5_by_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Checksums of byte ranges, read where they lie, a megabyte at a time."""
    import hashlib
    from urllib.parse import quote

    from pyarrow import fs

    for pdf in batches:
        sums = []
        for uri, start, left in zip(pdf["path"], pdf["start"], pdf["bytes"]):
            store, path = fs.FileSystem.from_uri(quote(_local_uri(uri), safe=":/@"))
            digest, at = hashlib.md5(), int(start)
            with store.open_input_file(path) as f:
                while left > 0 and (block := f.read_at(min(int(left), 1 << 20), at)):
                    digest.update(block)
                    at, left = at + len(block), left - len(block)
            sums.append(digest.hexdigest())
        yield pdf.assign(md5=sums)[["path", "part", "bytes", "md5"]]


def range_digests(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, *, recursive: bool = False) -> DataFrame:
    """name, part, bytes, md5: one row for each range of ``range_bytes`` of each file in a folder. Spark's readers do not list empty files, so these have none.

    Ranges are dealt to tasks, so a very large file is read by many of them. With ``recursive``, files below are found too
    and named by their path from the folder.
    """
    if range_bytes < 1:
        raise ValueError("a range has one byte at least")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    listed = reader.load(folder).select("path", "length")
    last = (F.ceil(F.col("length") / range_bytes) - 1).cast("bigint")
    listed = listed.where("length > 0")
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    start = F.col("part") * range_bytes
    cut = ranges.select("path", "part", start.alias("start"), F.least(F.lit(range_bytes), F.col("length") - start).cast("bigint").alias("bytes"))
    hashed = cut.repartition("path", "part").mapInPandas(_md5_by_range, "path string, part bigint, bytes bigint, md5 string")
    tail = folder.rstrip("/").rsplit("/", 1)[-1]
    name = F.substring_index(F.col("path"), f"/{tail}/", -1) if recursive else F.regexp_extract("path", r"([^/]+)$", 1)
    return hashed.select(name.alias("name"), "part", "bytes", "md5").withMetadata("part", {"range_bytes": range_bytes})


def range_roots(ranges: DataFrame) -> DataFrame:
    """name, size_bytes, checksum of whole files: the md5 of a file of one range, else ``ranges-<bytes>:`` and the md5 of its ranges' md5s in order."""
    size = ranges.schema["part"].metadata.get("range_bytes", RANGE_BYTES)
    each = F.array_sort(F.collect_list(F.struct("part", "md5")))
    whole = ranges.groupBy("name").agg(F.sum("bytes").alias("size_bytes"), each.alias("_e"))
    joined = F.md5(F.concat_ws("", F.col("_e.md5")))
    checksum = F.when(F.size("_e") == 1, F.concat(F.lit("md5:"), F.col("_e")[0]["md5"])).otherwise(F.concat(F.lit(f"ranges-{size}:"), joined))
    return whole.select("name", "size_bytes", checksum.alias("checksum"))


def verify_ranges(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """name, part, status of each range: MISSING, UNKNOWN (not recorded), SHORT (fewer or more bytes), MISMATCH or ok."""
    keys = ["name", "part"]
    was = recorded.select(*keys, F.col("bytes").alias("b0"), F.col("md5").alias("m0"))
    now = found.select(*keys, F.col("bytes").alias("b1"), F.col("md5").alias("m1"))
    status = (
        F.when(F.col("m1").isNull(), "MISSING").when(F.col("m0").isNull(), "UNKNOWN")
        .when(F.col("b0") != F.col("b1"), "SHORT").when(F.col("m0") != F.col("m1"), "MISMATCH").otherwise("ok")
    )
    return was.join(now, keys, "full").select(*keys, status.alias("status"))
