"""Token-id files: an adaptive context-mixing range coder over blocks of ids.

A file row is a segment: a table of document ids and lengths, and blocks of equally many ids, each with a
CRC-32. Every block starts with an empty model, so any block can be decoded alone. Within a block, order 1 and
order 2 (the one or two ids before) each remember which id came last; a logistic mixer turns their confidences
into the probability that the next id is the predicted one, and one binary decision says whether it is. If not,
order 0 codes the id in four adaptive digits of 4 bits, and learns from such ids alone. All blocks of a segment advance together, one id at a
time, as arrays over the blocks; arithmetic is in integers only, so files are the same on every machine.

Fixed layout, little-endian: magic ``TIDS``, version u32, documents u32, ids in all u64, block length u32, blocks
u32; document ids i64 and their lengths u32; then for each block its bytes u32 and CRC-32 u32 of the ids; then the
blocks' payloads, 32-bit words.
"""

from __future__ import annotations

import math
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

HEADER = "<4sIIQII"
MAGIC, VERSION = b"TIDS", 2
#: Ids per segment at most (a longer document has a segment of its own), per block at least and at most, and blocks wanted.
SEGMENT, SHORTEST, LONGEST, LANES = 1 << 22, 256, 4096, 1024
#: Bytes of pieces and their ids a task remembers before it starts afresh, those a piece takes beside these, and the
#: length from which a piece is not remembered.
REMEMBERED, OWN_BYTES, LONG = 64 << 20, 150, 1 << 12

_SLOTS, _RATE = 12, 4


def _mixer_tables():
    squash = np.array([round(4096 / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], dtype=np.int32).clip(1, 4095)
    stretch = np.array([max(-2047, min(2047, round(256 * math.log(max(p, 0.5) / (4096 - max(p, 0.5)))))) for p in range(4096)], dtype=np.int32)
    return squash, stretch


def _digit_targets():
    """Row s: what the 17 bounds of a digit's table move to when s was seen; every digit keeps some width."""
    bounds = np.arange(17, dtype=np.int32) * 32
    return np.array([bounds + (np.arange(17) > s) * (65536 - 16 * 32) for s in range(16)], dtype=np.int32)


class _Model:
    """What the coder and the decoder both know, for all blocks of a segment at once."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.squash, self.stretch = _mixer_tables()
        self.targets = _digit_targets()
        self.digits = [np.tile((np.arange(17, dtype=np.int32) * 4096).astype(np.uint32).clip(0, 65535).astype(np.uint16), (lanes, n, 1)) for n in (1, 16, 256, 4096)]
        self.predicted = [np.zeros((lanes, 1 << _SLOTS), np.uint16) for _ in range(2)]
        self.confidence = [np.zeros((lanes, 1 << _SLOTS), np.uint8) for _ in range(2)]
        self.hit_rate = [np.tile(np.array([40] + [min(3900, 700 + 450 * c) for c in range(1, 8)], np.int32), (lanes, 1)) for _ in range(2)]
        self.weight = [np.full(lanes, 40000, np.int32) for _ in range(2)]
        self.before, self.earlier = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def predict(self):
        """(probability of 65536 that the predicted id comes, predicted id)."""
        lane = self.lane
        one = (self.before * np.uint32(2654435761)) >> np.uint32(32 - _SLOTS)
        two = ((self.before * np.uint32(2246822519)) ^ (self.earlier * np.uint32(3266489917))) >> np.uint32(32 - _SLOTS)
        self.slot = (one, two)
        ids = [p[lane, s] for p, s in zip(self.predicted, self.slot)]
        self.sure = [c[lane, s] for c, s in zip(self.confidence, self.slot)]
        use_two = self.sure[1] > 0
        self.guess = np.where(use_two, ids[1], ids[0])
        self.agree = [ids[0] == self.guess, use_two]
        self.inputs = [np.where(a, self.stretch[r[lane, c]], 0) for a, r, c in zip(self.agree, self.hit_rate, self.sure)]
        mixed = (self.inputs[0] * self.weight[0] + self.inputs[1] * self.weight[1]) >> 16
        none = (self.sure[0] == 0) & ~use_two
        self.p = np.where(none, 8, self.squash[np.clip(mixed, -2047, 2047) + 2047])
        return (self.p << 4).clip(16, 65520), self.guess

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        lane = self.lane
        error = ((hit.astype(np.int32) << 12) - self.p) * 6
        for k in range(2):
            self.weight[k] += (self.inputs[k] * error + 0x8000) >> 16
            old, sure, slot = self.predicted[k][lane, self.slot[k]], self.sure[k], self.slot[k]
            same = (old == ids) & (sure > 0)
            rate = self.hit_rate[k][lane, sure]
            self.hit_rate[k][lane, sure] = (rate + (((same.astype(np.int32) << 12) - rate) >> 5)).clip(8, 4088)
            self.confidence[k][lane, slot] = np.where(same, np.minimum(sure + 1, 7), np.where(sure > 2, sure >> 1, 1))
            self.predicted[k][lane, slot] = np.where(same | (sure <= 2), ids, old)
        self.earlier, self.before = self.before, ids.astype(np.uint32)

    def table(self, level: int, at: np.ndarray, context: np.ndarray) -> np.ndarray:
        rows = self.digits[level][at, context].astype(np.int32)
        rows[:, 16] = 65536
        return rows

    def adapt(self, level: int, at: np.ndarray, context: np.ndarray, rows: np.ndarray, digit: np.ndarray) -> None:
        moved = rows + ((self.targets[digit] - rows) >> _RATE)
        moved[:, 16] = 65535
        self.digits[level][at, context] = moved.astype(np.uint16)


_WORD, _LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)
_NARROW = np.uint64(1 << 32)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_EVERY = slice(None)


def _tight(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Blocks whose interval is narrow: one that crosses a word's bound is cut there, so that the word is settled."""
    at = np.nonzero(width < _NARROW)[0]
    if len(at):
        crosses = ((low[at] ^ (low[at] + width[at] - np.uint64(1))) >> _WORD) != 0
        cut = at[crosses]
        width[cut] = (~low[cut] + np.uint64(1)) & _LOW32
    return at


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One payload for each row of ``ids`` (uint16, blocks x block length)."""
    lanes, steps = ids.shape
    model = _Model(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)
    words = np.zeros((lanes, steps + 16), np.uint32)
    count = np.zeros(lanes, np.int64)

    def put(at, start, size):
        nonlocal words
        step = width[at] >> np.uint64(16)
        lo = low[at] + step * start.astype(np.uint64)
        wide = step * size.astype(np.uint64)
        done = _tight(lo, wide)
        if len(done):
            if count.max() + 4 >= words.shape[1]:
                words = np.concatenate([words, np.zeros_like(words)], axis=1)
            full = model.lane[at][done]
            words[full, count[full]] = (lo[done] >> _WORD).astype(np.uint32)
            count[full] += 1
            lo[done] <<= _WORD
            wide[done] <<= _WORD
        low[at], width[at] = lo, wide

    for t in range(steps):
        now = ids[:, t]
        p, guess = model.predict()
        hit = now == guess
        put(_EVERY, np.where(hit, 0, p), np.where(hit, p, 65536 - p))
        missed = np.nonzero(~hit)[0]
        wide, row = now[missed].astype(np.int64), model.lane[: len(missed)]
        for level in range(4 if len(missed) else 0):
            context, digit = wide >> (16 - 4 * level), (wide >> (12 - 4 * level)) & 15
            rows = model.table(level, missed, context)
            start = rows[row, digit]
            put(missed, start, rows[row, digit + 1] - start)
            model.adapt(level, missed, context, rows, digit)
        model.learn(now, hit)
    for shift in (32, 0):
        if count.max() + 2 >= words.shape[1]:
            words = np.concatenate([words, np.zeros_like(words)], axis=1)
        words[np.arange(lanes), count] = ((low >> np.uint64(shift)) & _LOW32).astype(np.uint32)
        count += 1
    return [words[k, : count[k]].astype("<u4").tobytes() for k in range(lanes)]


def decode_blocks(payloads: list[bytes], steps: int) -> np.ndarray:
    """The ids (uint16, blocks x block length) of payloads of ``encode_blocks``."""
    lanes = len(payloads)
    sizes = [len(x) // 4 for x in payloads]
    words = np.zeros((lanes, max(sizes) + 2), np.uint64)
    for k, x in enumerate(payloads):
        words[k, : sizes[k]] = np.frombuffer(x, "<u4")
    model = _Model(lanes)
    lane = model.lane
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _ALL)
    code = (words[:, 0] << _WORD) | words[:, 1]
    position = np.full(lanes, 2)

    def share(at):
        return np.minimum((code[at] - low[at]) // (width[at] >> np.uint64(16)), np.uint64(65535)).astype(np.int64)

    def take(at, start, size):
        step = width[at] >> np.uint64(16)
        lo = low[at] + step * start.astype(np.uint64)
        wide = step * size.astype(np.uint64)
        done = _tight(lo, wide)
        if len(done):
            full = lane[at][done]
            code[full] = (code[full] << _WORD) | words[full, np.minimum(position[full], words.shape[1] - 1)]
            position[full] += 1
            lo[done] <<= _WORD
            wide[done] <<= _WORD
        low[at], width[at] = lo, wide

    out = np.zeros((lanes, steps), np.uint16)
    for t in range(steps):
        p, guess = model.predict()
        hit = share(_EVERY) < p
        take(_EVERY, np.where(hit, 0, p), np.where(hit, p, 65536 - p))
        missed = np.nonzero(~hit)[0]
        context, row = np.zeros(len(missed), np.int64), lane[: len(missed)]
        for level in range(4 if len(missed) else 0):
            rows = model.table(level, missed, context)
            digit = (rows[:, 1:16] <= share(missed)[:, None]).sum(axis=1)
            start = rows[row, digit]
            take(missed, start, rows[row, digit + 1] - start)
            model.adapt(level, missed, context, rows, digit)
            context = context * 16 + digit
        now = guess.astype(np.uint16)
        now[missed] = context
        model.learn(now, hit)
        out[:, t] = now
    return out


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of the file; ``ids`` are those of all its documents, one after the other, each below 65536."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids of 65536 and more are not in this format")
    steps = min(LONGEST, max(SHORTEST, -(-len(ids) // LANES)))
    n_blocks = -(-len(ids) // steps)
    padded = np.zeros(n_blocks * steps, np.uint16)
    padded[: len(ids)] = ids
    payloads = encode_blocks(padded.reshape(n_blocks, steps)) if n_blocks else []
    sums = [zlib.crc32(ids[k * steps : (k + 1) * steps].astype("<u4").tobytes()) for k in range(n_blocks)]
    index = np.array([[len(x), s] for x, s in zip(payloads, sums)], dtype="<u4").tobytes()
    head = struct.pack(HEADER, MAGIC, VERSION, len(doc_ids), len(ids), steps, n_blocks)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), index, *payloads])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a segment; a damaged one raises."""
    magic, version, n_docs, n_ids, steps, n_blocks = struct.unpack_from(HEADER, raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of token ids")
    at = struct.calcsize(HEADER)
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    lengths = np.frombuffer(raw, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    index = np.frombuffer(raw, "<u4", 2 * n_blocks, at).reshape(n_blocks, 2)
    at += 8 * n_blocks
    payloads = []
    for size, _ in index.tolist():
        payloads.append(raw[at : at + size])
        at += size
    ids = decode_blocks(payloads, steps).reshape(-1)[:n_ids].astype("<u4") if n_blocks else np.zeros(0, "<u4")
    for k, (_, crc) in enumerate(index.tolist()):
        if zlib.crc32(ids[k * steps : (k + 1) * steps].tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
    return doc_ids, lengths, ids


def _tokenizer(vocabulary: str):
    """texts -> their ids; pieces between blanks are encoded once by the library and remembered."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one it may use
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    blank = re.compile(r"[ \t\n\r\f\v]+")
    known: dict[str, bytes] = {"": b""}
    held = 0

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal held
        cuts = [blank.split(x) for x in texts]
        if held > REMEMBERED:
            known.clear()
            known[""] = b""
            held = 0
        new = list({y for c in cuts for y in c}.difference(known))
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            known.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(some, tokenizer.encode_batch(some, add_special_tokens=False)))
        out = [b"".join(map(known.__getitem__, c)) for c in cuts]
        for x in new:
            if len(x) < LONG:
                held += 4 * len(x) + len(known[x]) + OWN_BYTES
            else:
                del known[x]
        return out

    return encode


def _segments_of(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, part = _tokenizer(vocabulary), TaskContext.get().partitionId()
    end = struct.pack("<I", end_id)
    docs, coded, size, number = [], [], 0, 0

    def segment():
        lengths = np.array([len(x) // 4 for x in coded])
        raw = write_segment(np.array(docs, np.int64), lengths, np.frombuffer(b"".join(coded), "<u4"))
        return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "n_ids": [int(lengths.sum())], "segment": [raw]}, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("n_ids", pa.int64()), ("segment", pa.binary())]))

    for batch in batches:
        for row in range(batch.num_rows):
            ids = encode([batch.column(1)[row].as_py() or ""])[0] + end
            if docs and size + len(ids) // 4 > SEGMENT:
                yield segment()
                docs, coded, size, number = [], [], 0, number + 1
            docs.append(batch.column(0)[row].as_py())
            coded.append(ids)
            size += len(ids) // 4
    if docs:
        yield segment()


def write_ids(docs: DataFrame, path: str, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of all rows of ``docs``, each with ``end_id`` behind it, in ascending order of id.

    The folder holds Parquet files of (part, number, n_ids, segment); parts and numbers give the order, so any
    store that Spark writes to will do, and a lost executor's part is written again. ``vocabulary_path`` is a
    tokenizers file that drops white space; the driver reads it and broadcasts it. A null text is empty and
    has only the end id. A text is encoded whole, and a longer one than a segment has a segment of its own. Rows without an id have no place in the order and raise an error; rows with the same id all stay, in any order.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary file of more than 64 MB is not broadcast")
    vocabulary = docs.sparkSession.sparkContext.broadcast(raw)
    doc_id = F.coalesce(F.col(id_col).cast("bigint"), F.raise_error(F.lit("a row without an id has no place in the order")).cast("bigint"))
    rows = docs.select(doc_id.alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    # the row number spreads an id that many rows have
    ordered = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "text")
    ordered.mapInArrow(lambda batches: _segments_of(batches, vocabulary.value, end_id), "part int, number int, n_ids bigint, segment binary").write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids, lengths, ids = read_segment(batch.column(1)[row].as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            flat = ids.tobytes()
            for k in range(0, len(doc_ids), 4096):
                some = slice(k, k + 4096)
                raw = [flat[4 * a : 4 * b] for a, b in zip(starts[some], ends[some])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids[some]), pa.array(starts[some] + batch.column(0)[row].as_py()), pa.array(raw, pa.binary())], names=["id", "start", "ids"]
                )


def read_ids(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) of each document in a folder of ``write_ids``: ids before it, and its own as binary, four bytes each."""
    files = spark.read.schema("part int, number int, n_ids bigint, segment binary").parquet(path)
    sizes = files.select("part", "number", "n_ids")
    # one row per writing task, then the segments of each task
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    placed = sizes.withColumn("_within", within).join(before, "part").select("part", "number", (F.col("_before") + F.col("_within")).alias("first"))
    rows = files.join(placed, ["part", "number"]).select("first", "segment")
    return rows.mapInArrow(_read, "id bigint, start bigint, ids binary").withColumnRenamed("id", id_col)
