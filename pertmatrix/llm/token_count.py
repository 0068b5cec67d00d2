"""Token counts: batch encoding in Arrow functions that return lengths only.

A byte-level vocabulary splits text before blanks, so a text may be cut before any space that follows a
character that is no white space, and the pieces encoded apart: their lengths add up. Pieces repeat far more
than texts, so each task encodes a piece once, new pieces in calls of about equal bytes, and adds up lengths.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Bytes per call of the tokenizer, bytes of pieces a task remembers before it starts afresh, those a piece takes
#: beside its text, and the length from which a piece is not remembered.
CALL_BYTES, REMEMBERED, OWN_BYTES, LONG = 1 << 20, 64 << 20, 150, 1 << 12

_UNSAFE = re.compile(r"\s(?= )")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")


def safe_pieces(text: str) -> list[str]:
    """``text`` cut before each space that follows a character that is no white space."""
    if _UNSAFE.search(text) is None and not text.startswith(" "):
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]
    return _SAFE_CUT.split(text)


def n_bytes(text: str) -> int:
    """UTF-8 bytes."""
    return len(text) if text.isascii() else len(text.encode())


def balanced(pieces: list[str], most: int = CALL_BYTES) -> Iterator[list[str]]:
    """Runs of pieces of at most ``most`` UTF-8 bytes each; a longer piece is a run of its own."""
    run, size = [], 0
    for x in pieces:
        n = n_bytes(x)
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += n
    if run:
        yield run


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    known: dict[str, int] = {}
    held = 0
    for batch in batches:
        counts = []
        for text in batch.column(1).to_pylist():
            pieces = safe_pieces(text) if text else []
            if held > REMEMBERED:
                known.clear()
                held = 0
            new = [x for x in dict.fromkeys(pieces) if x not in known]
            for run in balanced(new):
                known.update(zip(run, map(len, tokenizer.encode_batch(run, add_special_tokens=False))))
            counts.append(sum(map(known.__getitem__, pieces)))
            for x in new:
                if len(x) < LONG:
                    held += n_bytes(x) + OWN_BYTES
                else:
                    del known[x]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit) for each row of ``docs``, repeated rows included.

    ``vocabulary_path`` is a tokenizers file with a byte-level pre-tokenizer without a prefix space; the driver
    reads it and broadcasts it. A null text is empty: no bytes, no tokens. Other columns are ignored. Texts are
    counted to their end; a task holds one batch, the pieces of one text, and at most REMEMBERED bytes of earlier ones.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    if '"ByteLevel"' not in raw:
        raise ValueError("safe boundaries are known for byte-level vocabularies only")
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(raw)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(lambda batches: _counted(batches, vocabulary.value), f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
