"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is what BPE makes of its bytes exactly if each pair of neighbours is, and every prefix of a
text has exactly one such sequence. So it is enough to store, for each byte prefix, the last token of its
sequence: the token that ends there, and whose pair with the last token of the prefix before it is right.
Reading the table from the end gives the ids. Appending bytes only adds entries, and after an edit the old
entries hold again as soon as the table has joined the old one for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: How many pairs of tokens, and how many bytes of pieces of text, a task remembers before it starts afresh. A piece
#: counts with what its two objects take besides; pieces of more than LONG characters are not remembered.
PAIRS, REMEMBERED, LONG, OVERHEAD = 1 << 20, 1 << 27, 64, 160


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in raw.splitlines() if line.strip())}


class _Node:
    """A state of the matching automaton: the longest beginning of a token that the bytes read so far end with."""

    __slots__ = ("text", "next", "tokens")

    def __init__(self, text: bytes):
        self.text = text
        self.next: dict[int, _Node] = {}
        #: (length, token, what is known of the tokens before it) of all tokens that end here, the longest first.
        self.tokens: list[tuple[int, int, dict[int, bool]]] = []


class PrefixBPE:
    """Encoder and decoder for one table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._beginnings = {t[:k] for t in ranks for k in range(len(t) + 1)} | {b""}
        self._nodes: dict[bytes, _Node] = {}
        self._known: dict[int, dict[int, bool]] = {}
        self._spines: dict[int, tuple | None] = {}
        self._pairs = 0

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition, for a few bytes: join the neighbours with the lowest rank, leftmost first."""
        return [self.ranks[x] for x in self._merges(data)[0]]

    def _merges(self, data: bytes) -> tuple[list[bytes], list, list]:
        """What BPE makes of ``data``, and how its first and its last part grew: [(part, highest rank merged before it grew on)].

        The last entry of either has no such rank.
        """
        get, never = self.ranks.get, sys.maxsize
        at = list(range(len(data) + 1))
        ranks = [get(data[k : k + 2], never) for k in range(len(data) - 1)]
        head, tail, high, low = [], [], -1, -1
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            k, high, low = ranks.index(rank), max(high, rank), max(low, rank)
            if k == 0:
                head.append((data[: at[1]], high))
                high = -1
            if k == len(ranks) - 1:
                tail.append((data[at[-2] :], low))
                low = -1
            del at[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get(data[at[k] : at[k + 2]], never)
            if k:
                ranks[k - 1] = get(data[at[k - 1] : at[k + 1]], never)
        parts = [data[x:y] for x, y in zip(at, at[1:])]
        return parts, [*head, (parts[0], never)], [*tail, (parts[-1], never)]

    def _spine(self, token: int) -> tuple | None:
        """How the first and the last part of a token grow while BPE makes it; None if BPE does not make it of its bytes."""
        if token not in self._spines:
            parts, head, tail = self._merges(self.tokens[token])
            self._spines[token] = (head, tail) if len(parts) == 1 else None
        return self._spines[token]

    def _check(self, before: int, token: int) -> bool:
        """Whether BPE makes just these two tokens of their bytes; ``before`` -1: just ``token``. Remembered.

        It does if each is made of its own bytes and nothing is ever merged across the seam. Of two sides that
        grow independently, the one with the lower highest rank ahead grows first; the parts at the seam merge if their
        rank comes before what holds up either side, the left one first among equals.
        """
        mine, right = self._spine(token), True
        if mine is None:
            right = False
        elif before >= 0:
            if (other := self._spine(before)) is None:
                right = False
            else:
                x, y, i, j, never = other[1], mine[0], 0, 0, sys.maxsize
                while True:
                    (left, left_high), (follow, follow_high) = x[i], y[j]
                    seam = self.ranks.get(left + follow, never)
                    if seam < left_high and seam <= follow_high and seam != never:
                        right = False
                        break
                    if left_high == follow_high == never:
                        break
                    if left_high <= follow_high:
                        i += 1
                    else:
                        j += 1
        if self._pairs >= PAIRS:
            for known in self._known.values():
                known.clear()
            self._pairs = 0
        self._pairs += 1
        self._known[token][before] = right
        return right

    def _node(self, text: bytes) -> _Node:
        """The state for bytes that end with ``text``."""
        while text not in self._beginnings:
            text = text[1:]
        if text not in self._nodes:
            node = self._nodes[text] = _Node(text)
            for k in range(len(text)):
                token = self.ranks.get(text[k:])
                if token is not None:
                    node.tokens.append((len(text) - k, token, self._known.setdefault(token, {})))
        return self._nodes[text]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> None:
        """Fill ``last`` (the last token for each prefix of 1, 2, ... bytes) up to ``stop`` bytes, from where it ends."""
        done = len(last)
        self._fill(data, last, [self._node(data[max(0, done - self.longest) : done])], stop)

    def _fill(self, data: bytes, last: list[int], nodes: list[_Node], stop: int | None = None) -> None:
        """``extend`` from the state ``nodes`` ends with, adding that of each byte.

        A matching automaton names the tokens that end at a byte, and nothing else; only one of them is right, so any
        that passes ends the search.
        """
        node, at, check = nodes[-1], len(last), self._check
        for byte in data[at:stop]:
            then = node.next.get(byte)
            if then is None:
                then = node.next[byte] = self._node(node.text + bytes((byte,)))
            node = then
            for length, token, known in node.tokens:
                before = last[at - length] if at >= length else -1
                right = known.get(before)
                if right or right is None and check(before, token):
                    break
            else:
                raise ValueError(f"byte {byte} is no token")
            last.append(token)
            nodes.append(node)
            at += 1

    def ids_of(self, last: list[int], upto: int | None = None) -> list[int]:
        """Ids of the first ``upto`` bytes, read from the end of the table."""
        out, end = [], len(last) if upto is None else upto
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, list[int]]:
        """Ids of matches of the splitting pattern; a match that is itself a token is that token.

        In sorted order a piece mostly begins as the one before it, whose entries are then kept.
        """
        out, before, last, nodes = {}, b"", [], [self._node(b"")]
        ranks, fill, tokens = self.ranks, self._fill, self.tokens
        for data in sorted(pieces):
            if (whole := ranks.get(data)) is not None:
                out[data] = [whole]
                continue
            same = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                same += 1
            del last[same:], nodes[same + 1 :]
            fill(data, last, nodes)
            ids, end = [], len(data)
            while end:
                token = last[end - 1]
                ids.append(token)
                end -= len(tokens[token])
            ids.reverse()
            before, out[data] = data, ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class EditableText:
    """One piece of bytes with its table: appends at the end and edits inside without encoding all of it again."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, []
        #: Entries computed by the latest change.
        self.computed = len(data)
        bpe.extend(data, self.last)

    def ids(self) -> list[int]:
        return self.bpe.ids_of(self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.computed = len(more)
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in the place of bytes ``start`` to ``stop``."""
        data, tail = self.data[:start] + new + self.data[stop:], self.last[stop:]
        last, shift = self.last[:start], start + len(new)
        same = 0
        while len(last) < len(data) and same < self.bpe.longest:
            self.bpe.extend(data, last, len(last) + 1)
            same = same + 1 if len(last) > shift and last[-1] == tail[len(last) - shift - 1] else 0
        self.computed = len(last) - start
        self.data, self.last = data, last + tail[len(last) - shift :] if len(last) < len(data) else last


def _keeps_words(pattern: str) -> bool:
    """Whether a blank and ASCII letters are one match of the pattern: only what begins with an apostrophe comes before."""
    first, found, _ = f"|{pattern}|".partition(r"| ?\p{L}+|")
    return bool(found) and all(x.startswith("'") for x in first.split("|") if x)


def _encoder(ranks: bytes, pattern: str):
    """texts -> their ids as bytes, with a memory for pieces between blanks, which BPE never joins."""
    import re
    import struct

    import regex

    bpe, split = PrefixBPE(read_ranks(ranks)), regex.compile(pattern)
    unsafe, cut = re.compile(r"\s(?= )"), re.compile(r"(?<=\S)(?= )")
    one_match = re.compile(" ?[A-Za-z]+") if _keeps_words(pattern) else re.compile("(?!)")
    packs = [struct.Struct(f"<{n}I").pack for n in range(LONG)]
    known: dict[str, bytes] = {}
    size = 0

    def pieces_of(text: str) -> list[str]:
        if unsafe.search(text) is None and not text.startswith(" "):
            return text.replace(" ", "\0 ").split("\0") if "\0" not in text else cut.split(text)
        return cut.split(text)

    def matches(piece: str) -> list[bytes]:
        return [piece.encode()] if one_match.fullmatch(piece) else [m.encode() for m in split.findall(piece)]

    def packed(ids: list[int]) -> bytes:
        return packs[len(ids)](*ids) if len(ids) < LONG else struct.pack(f"<{len(ids)}I", *ids)

    def encode(texts: list[str]) -> Iterator[bytes]:
        nonlocal size
        cuts = [pieces_of(x) for x in texts]
        if size > REMEMBERED:
            known.clear()
            size = 0
        new = {x: matches(x) for x in set().union(*cuts).difference(known)}
        ids = {m: packed(x) for m, x in bpe.encode_pieces({m for ms in new.values() for m in ms}).items()}
        once = {}
        for x, ms in new.items():
            coded = ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms])
            if len(x) <= LONG:
                known[x] = coded
                size += len(x) + len(coded) + OVERHEAD
            else:
                once[x] = coded
        if once:
            return (b"".join([known[x] if x in known else once[x] for x in c]) for c in cuts)
        return (b"".join(map(known.__getitem__, c)) for c in cuts)

    return encode


def _groups(batch: pa.RecordBatch, most: int = 1 << 22) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``most`` characters; a longer text is alone."""
    first, texts, size = 0, [], 0
    for row in range(batch.num_rows):
        text = batch.column(1)[row].as_py() or ""
        if texts and size + len(text) > most:
            yield first, texts
            first, texts, size = row, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _coded(batches: Iterator[pa.RecordBatch], ranks: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    encode = _encoder(ranks, pattern)
    for batch in batches:
        for first, texts in _groups(batch):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(encode(texts), pa.binary(), size=len(texts))], names=["id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow.compute as pc

    tokens = {r: t for t, r in read_ranks(ranks).items()}

    def text_of(raw: bytes) -> bytes:
        return b"".join(map(tokens.__getitem__, np.frombuffer(raw, dtype="<u4").tolist()))

    for batch in batches:
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        first = 0
        while first < batch.num_rows:  # runs of rows of about as many bytes as texts are read in
            run = int(max(1, np.searchsorted(np.cumsum(sizes[first:]), 1 << 22, side="right")))
            part = batch.slice(first, run)
            texts = [text_of(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], names=["id", "ids", "bytes"])
            first += run


def _shared(spark, ranks_path: str):
    with open(ranks_path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("a file of ranks of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, ids) for each row of ``docs``; ids are little-endian unsigned 32-bit integers in one binary.

    ``pattern`` must split before a space that follows a character that is no white space, as the usual patterns
    do; each of its matches is encoded by itself, without special tokens. A null text is empty and has no ids.
    Repeated rows stay; other columns are ignored.
    """
    ranks = _shared(docs.sparkSession, ranks_path)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(lambda batches: _coded(batches, ranks.value, pattern), f"id {kind}, ids binary")
    return out.select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """``encoded`` (id, ids) with the column bytes: what the ids stand for. Null ids are none."""
    ranks = _shared(encoded.sparkSession, ranks_path)
    rows = encoded.select(F.col(id_col).alias("id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(lambda batches: _decoded(batches, ranks.value), f"id {kind}, ids binary, bytes binary")
    return out.select(F.col("id").alias(id_col), "ids", "bytes")
