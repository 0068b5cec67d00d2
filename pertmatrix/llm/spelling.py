"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams have one order, rare ones first. A word's prefix is its three rarest bigrams; of these, dynamic programming
chooses the two disjoint ones that fewest words have: the pivots. One edit cannot touch both pivots, and a pivot it
does not touch stands among the other word's prefix if that word's third bigram is no rarer than the own one's. So
for two words one edit apart, some pivot of one is in the prefix of the other, at the same place counted from the
side the edit does not touch. Pivots are indexed and prefixes look them up by bigram, place and all letters on
that side; what meets is verified by its distance.

Where more than ``LARGE`` entries meet under one key, no pairs are made. The words that meet there are matched by what
is left of them when one letter is taken out: groups of at most one word for each letter of the alphabet.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pertmatrix.llm.common import LOWER, UPPER
from pertmatrix.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Letters of a word; only A-Z have lower-case forms here. There are 64 + 26 in counted words.
LETTERS = r"A-Za-zÀ-ÿ"
#: Bigrams of those letters.
BIGRAMS = 90 * 90
#: Entries under one key up to which pairs are made; this only chooses the way, every pair is found.
LARGE = 64
#: Different words, and characters in them, that a task counts before it passes the counts on; characters read at once.
WORDS, CHARS, SLICE = 1 << 18, 1 << 24, 1 << 20
#: Modulus and base of the running hashes that name parts of words.
PRIME, BASE = (1 << 61) - 1, 0x1F2E3D4C5B6A79

_DOWN = str.maketrans(UPPER, LOWER)


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_DOWN)


def _slices(text: str, size: int) -> Iterator[str]:
    """A text in slices of about ``size`` characters that end behind a run of letters."""
    outside, start = re.compile(f"[^{LETTERS}]"), 0
    while len(text) - start > size:
        cut = outside.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _counted(batches: Iterator[pa.RecordBatch], least: int, respell: Callable[[object, str], str] | None) -> Iterator[pa.RecordBatch]:
    runs, total, chars = re.compile(f"[{LETTERS}]{{{least},}}"), Counter(), 0

    def told():
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py()
            if not text:
                continue
            own = batch.column(0)[row].as_py()
            for piece in _slices(text, SLICE):
                lowered = Counter()
                for run, n in Counter(runs.findall(piece)).items():
                    lowered[_lower(run)] += n
                for word, n in lowered.items():
                    if respell is not None and len(word := respell(own, word)) < least:
                        continue
                    if word not in total:
                        chars += len(word)
                    total[word] += n
                if len(total) > WORDS or chars > CHARS:
                    yield told()
                    chars = 0
    if total:
        yield told()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, respell: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n): how often each word of ``least_chars`` letters or more stands in all texts.

    A word is a maximal run of letters, A-Z lower-cased; ``respell(id, word)`` may change what is counted, by shorter or
    equal words only. Null and empty texts have no words; repeated rows count each time; other columns are ignored.
    Texts are read in slices of about a million characters, and a task's counts are passed on when they grow.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part = rows.mapInArrow(lambda batches: _counted(batches, least_chars, respell), "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _grams(word: str) -> list[str]:
    return [word[k : k + 2] for k in range(len(word) - 1)]


def _bigram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = Counter()
        for word in batch.column(0).to_pylist():
            seen.update(set(_grams(word)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "words"])


def prefix_and_pivots(word: str, order: dict[str, tuple[int, str]]) -> tuple[list[int], list[int]]:
    """Places of a word's prefix bigrams (with all further ones that equal the last) and of its two pivots.

    ``order`` gives (number of words, bigram). Pivots are the two disjoint prefix bigrams with the fewest words in
    sum: the best one that ends before each bigram is carried along from left to right.
    """
    ranked = sorted((order[g], k) for k, g in enumerate(_grams(word)))
    three = sorted((k, rank) for rank, k in ranked[:3])
    best, chosen, waiting = None, None, []
    for k, (count, _) in three:
        while waiting and waiting[0][0] <= k - 2:
            before = waiting.pop(0)
            best = before if best is None or before[1] < best[1] else best
        if best is not None and (chosen is None or best[1] + count < chosen[0]):
            chosen = (best[1] + count, best[0], k)
        waiting.append((k, count))
    last = ranked[min(3, len(ranked)) - 1][0]
    return [k for rank, k in ranked if rank <= last], list(chosen[1:])


def _running(word: str) -> tuple[list[int], list[int], list[int]]:
    """Hashes of all beginnings and of all ends of a word, and the powers of the base."""
    codes = [ord(c) for c in word]
    heads, powers = [0], [1]
    for c in codes:
        heads.append((heads[-1] * BASE + c) % PRIME)
        powers.append(powers[-1] * BASE % PRIME)
    whole, n = heads[-1], len(word)
    return heads, [(whole - heads[k] * powers[n - k]) % PRIME for k in range(n + 1)], powers


def _keyed(batches: Iterator[pa.RecordBatch], order: dict[str, tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """(key, pivot, word, n): each prefix bigram with all letters to its left, and with all to its right."""
    for batch in batches:
        for first in range(0, batch.num_rows, 2048):
            keys, pivots, words, ns = [], [], [], []
            part = batch.slice(first, 2048)
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                prefix, chosen = prefix_and_pivots(word, order)
                heads, ends, _ = _running(word)
                for k in prefix:
                    for key in (heads[k + 2], -1 - ends[k]):
                        keys.append(key), pivots.append(k in chosen), words.append(word), ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pivots), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["key", "pivot", "word", "n"])


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rest, place, word, n): the hash of a word without its letter at ``place``; place -1 stands for any, -2 for the whole word."""
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            rests, places, words, ns = [], [], [], []
            part = batch.slice(first, 512)
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                heads, ends, powers = _running(word)
                size = len(word)
                left = [(heads[k] * powers[size - 1 - k] + ends[k + 1]) % PRIME for k in range(size)]
                mine = [*enumerate(left), *((-1, rest) for rest in set(left)), (-2, heads[-1])]
                places.extend(k for k, _ in mine), rests.extend(rest for _, rest in mine)
                words.extend([word] * len(mine)), ns.extend([n] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(rests, pa.int64()), pa.array(places, pa.int32()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["rest", "place", "word", "n"])


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n, other, other_n), each way round: the words (word, n) that differ by one inserted, deleted or replaced letter.

    Words have four letters or more, made of at most 90 different letters, and stand once in ``counts``.
    """
    frequency = materialized(counts.select("word").mapInArrow(_bigram_sets, "gram string, words bigint").groupBy("gram").agg(F.sum("words").alias("words")), "spelling-bigrams")
    found = frequency.limit(BIGRAMS + 1).collect()
    if len(found) > BIGRAMS:
        raise ValueError(f"more than {BIGRAMS} bigrams: words of other letters")
    order = {gram: (words, gram) for gram, words in found}
    keyed = materialized(counts.select("word", "n").mapInArrow(lambda batches: _keyed(batches, order), "key bigint, pivot boolean, word string, n bigint"), "spelling-keys")
    sizes = materialized(keyed.groupBy("key").agg(F.count("*").alias("size"), F.count_if("pivot").alias("pivots")).where("size > 1 AND pivots > 0"), "spelling-sizes")

    small = keyed.join(sizes.where(F.col("size") <= LARGE).select("key"), "key")
    index, probe = small.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n")), small.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    near_length = F.abs(F.length("a") - F.length("b")) <= 1
    met = index.join(probe, "key").where((F.col("a") != F.col("b")) & near_length).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")

    crowded = keyed.join(sizes.where(F.col("size") > LARGE).select("key"), "key", "left_semi").select("word", "n").distinct()
    rests = materialized(crowded.mapInArrow(_shortened, "rest bigint, place int, word string, n bigint"), "spelling-rests")
    one, other = (rests.select("rest", "place", F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    replaced = one.where("place >= 0").join(other.where("place >= 0"), ["rest", "place"]).where("a < b")
    longer = one.where("place = -1").drop("place").join(other.where("place = -2").drop("place"), "rest")
    matched = replaced.drop("rest", "place").unionByName(longer.drop("rest")).where(F.levenshtein("a", "b", 1) == 1)

    pairs = met.unionByName(matched)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    return both.toDF("word", "n", "other", "other_n").repartition("word").distinct()


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form) without cycles, by pointer jumping: a step halves what is left of every path."""
    now = materialized(forms.toDF("word", "root"), "spelling-roots")
    while True:
        up = now.toDF("root", "above")
        joined = now.join(up, "root", "left")
        moved = materialized(joined.select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "spelling-roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_groups(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``counts`` (word, n).

    n_near is the number of words one edit away; form is the most frequent of them, the smallest in code-point order
    among equals, where it is at least ``ratio`` times as frequent as the word, else null; root is where forms lead to,
    the word itself where it has none. An empty table gives none. ``ratio`` is above 1, so forms never lead back.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than the word")
    counts = materialized(counts.select("word", "n"), "spelling-words")
    near = near_words(counts)
    most = near.groupBy("word").agg(F.count("*").alias("n_near"), F.max("other_n").alias("top_n"), F.max("n").alias("n"), F.min_by("other", F.struct((-F.col("other_n")).alias("x"), "other")).alias("top"))
    chosen = F.col("top_n") >= ratio * F.col("n")
    judged = materialized(most.select("word", "n_near", F.when(chosen, F.col("top")).alias("form"), F.when(chosen, F.col("top_n")).alias("form_n")), "spelling-forms")
    roots = _rooted(judged.where("form IS NOT NULL").select("word", "form"))
    return (
        counts.join(judged, "word", "left").join(roots, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
    )
