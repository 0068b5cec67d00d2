"""Line dedup: a sorted sweep over range-partitioned line hashes, and a bitmap of kept lines for each document.

A document becomes one entry for each of its different long lines: the line's hash, the document, the line's
places. Entries are range-partitioned by hash and document, so a line that a third of all documents hold is
spread over many partitions, and sorted within them, the largest document of a hash first. One pass streams each
partition: the first document of a hash keeps the line, others lose it once enough documents have been seen. What
a partition cannot tell, as the hash goes on in the next or came from the one before, stays open and is settled
by a table of a few rows for each partition. The result names places, not texts: zlib-compressed bits for each
document that loses lines.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pertmatrix.llm.common import BLANKS, slices
from pertmatrix.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Entries in one output batch, and documents a task remembers so as not to send repeated rows again.
ENTRIES, RECENT = 1 << 15, 1 << 16


def _key_places(text: str, least: int) -> dict[bytes, list[int]]:
    """Hash of each different long line of a text -> its places."""
    from hashlib import blake2b

    found: dict[bytes, list[int]] = {}
    start, place = 0, 0
    while start <= len(text):
        stop = text.find("\n", start)
        stop = len(text) if stop < 0 else stop
        if stop - start >= least and len(line := text[start:stop].strip(BLANKS)) >= least:
            # bytes.lower changes A-Z only
            found.setdefault(blake2b(line.encode().lower(), digest_size=16).digest(), []).append(place)
        start, place = stop + 1, place + 1
    return found


def _entries(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    ids, prints, counts, keys, places = [], [], [], [], []
    names, id_type, recent = ["id", "print", "n_lines", "key", "places"], None, {}

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(prints, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=names)
        for x in (ids, prints, counts, keys, places):
            x.clear()
        return batch

    for batch in batches:
        id_type = batch.schema.field(0).type
        for row in range(batch.num_rows):
            own, text, mark = (batch.column(k)[row].as_py() for k in range(3))
            if (own, mark) in recent:
                continue
            if len(recent) >= RECENT:
                recent.clear()
            recent[own, mark] = True
            found = _key_places(text, least)
            n = text.count("\n") + 1 if found else 0
            for key, at in found.items():
                ids.append(own), prints.append(mark), counts.append(n), keys.append(key), places.append(at)
            if len(ids) >= ENTRIES:
                yield out()
    if ids:
        yield out()


def _swept(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
    """Entries of a sorted partition that lose their lines, entries still open, and totals of the hashes of open ones.

    ``docs`` is null for an entry that loses its lines, 0 for an open one; in a total it is the number of
    documents with the hash here, and id the first of them.
    """
    key, docs, last, top, first, told = None, 0, None, None, True, False
    held: list[tuple] = []
    rows: list[tuple] = []
    types = None

    def ended():
        # the first and the last hash of a partition may go on in another one, and held entries may have been passed on
        if key is not None and (first or told):
            rows.append((key, top, None, None, None, docs))

    for batch in batches:
        types = types or [batch.schema.field(0).type]
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for own, mark, n, this, at in zip(*columns):
            if this != key:
                if key is not None:
                    ended()
                    first = False
                key, docs, last, top, told = this, 0, None, own, False
                held.clear()
            if docs == 0 or own != last:
                docs, last = docs + 1, own
            if first:
                rows.append((this, own, mark, n, at, 0))
            elif docs >= enough:
                rows.extend((*x, None) for x in held)
                held.clear()
                rows.append((this, own, mark, n, at, None))
            elif docs > 1:
                held.append((this, own, mark, n, at))
        # what is held at the end of a batch is settled with the open entries, so nothing is held for long
        if held:
            rows.extend((*x, 0) for x in held)
            held.clear()
            told = True
        yield _told(rows, types[0])
        rows.clear()
    if key is not None:
        told = True
        ended()
        yield _told(rows, types[0])


def _told(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    keys, ids, prints, counts, places, docs = zip(*rows) if rows else ((),) * 6
    kinds = (pa.binary(), id_type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((keys, ids, prints, counts, places, docs), kinds)], names=["key", "id", "print", "n_lines", "places", "docs"])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    import numpy as np

    for batch in batches:
        dropped, bits = [], []
        for n, places in zip(batch.column(2).to_pylist(), batch.column(3)):
            keep = np.ones(n, bool)
            for at in places.values:
                keep[at.values.to_numpy()] = False
            dropped.append(int(n - keep.sum()))
            bits.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int64()), pa.array(bits, pa.binary())], names=["id", "print", "n_lines", "n_dropped", "keep"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """(id, print, n_lines, n_dropped, keep) for each different text of an id that loses lines; all others keep every line.

    Texts are split at newlines. A line's key is the line without the six blanks at both ends and with A-Z in lower
    case. Keys of ``least_chars`` code points or more found in ``least_docs`` documents or more (two at least) lose
    all their lines but those in the largest id holding them. ``keep`` holds zlib-compressed bits, the first line in
    the lowest bit of the first byte; ``print`` is the text's xxhash64, 42 as seed.

    Rows with one id are one document when documents are counted, and each of its texts has a bitmap of its own;
    repeated rows count once. A null id is the smallest. A null or empty text is one empty line. Keys are compared
    by 128-bit hashes: two different ones meet with a chance of about n * n / 2 ** 129. A task holds one text, a
    batch of entries and one text's places; no line's entries are gathered.
    """
    if least_docs < 2:
        raise ValueError("a line of one document is never dropped")
    rows = _rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, print bigint, n_lines bigint, key binary, places array<int>"
    entries = materialized(rows.mapInArrow(lambda batches: _entries(batches, least_chars), shape), "line-entries")
    # a hash and a document stay together, a hash alone need not
    order = [F.asc("key"), F.desc_nulls_last("id")]
    ranged = entries.repartitionByRange(slices(docs.sparkSession), *order).sortWithinPartitions(*order, "print")
    swept = materialized(
        ranged.mapInArrow(lambda batches: _swept(batches, least_docs), f"key binary, id {kind}, print bigint, n_lines bigint, places array<int>, docs bigint"), "line-swept"
    )
    totals = materialized(swept.where("docs > 0").groupBy("key").agg(F.sum("docs").alias("all_docs"), F.max("id").alias("top")).where(F.col("all_docs") >= least_docs), "line-totals")
    settled = swept.where("docs = 0").drop("docs").join(totals, "key").where(~F.col("id").eqNullSafe(F.col("top")))
    lost = swept.where("docs IS NULL").select("id", "print", "n_lines", "places").unionByName(settled.select("id", "print", "n_lines", "places"))
    by_text = lost.groupBy("id", "print").agg(F.max("n_lines").alias("n_lines"), F.collect_set("places").alias("places"))
    return by_text.mapInArrow(_bits, f"id {kind}, print bigint, n_lines bigint, n_dropped bigint, keep binary").withColumnRenamed("id", id_col)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    import numpy as np

    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            counts, dropped, texts = [], [], []
            for text, keep in zip(part.column(1), part.column(2).to_pylist()):
                text = text.as_py()
                n = text.count("\n") + 1
                counts.append(n)
                if keep is None:
                    dropped.append(0)
                else:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n, bitorder="little")
                    dropped.append(int(n - bits.sum()))
                    text = "\n".join(line for line, stays in zip(text.split("\n"), bits.tolist()) if stays)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())], names=["id", "n_lines", "n_dropped", "text"])


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines before, n_dropped, text) for each row of ``docs``: the lines its bitmap keeps, joined by newlines.

    A text that loses all lines is empty; a null text is empty. Repeated rows stay; other columns are ignored.
    """
    rows = _rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["id"]
    marked = bitmaps.select(F.col(id_col).alias("_id"), F.col("print").alias("_print"), "keep")
    joined = rows.join(marked, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left")
    out = joined.select("id", "text", "keep").mapInArrow(_cut, f"id {kind}, n_lines bigint, n_dropped bigint, text string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)
