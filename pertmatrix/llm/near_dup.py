"""Near-duplicate documents by HyperMinHash, exact links and components.

A document is its set of word shingles. Its signature has 256 registers of one byte: a shingle's hash names a
register and a value, and the register keeps, of the smallest value, the count of leading zeros (4 bits) and the
bits behind the first one (4 bits). Small sets use few registers per hash function and several functions, so that
registers are never starved; the layout depends on the size of the set only, and a set near the next size's bound
is signed in both layouts, so two sets that can be linked always share one.

Registers are banded by six. In a band's bucket no pairs are made: the most central member (the one with most
bucket mates) is the pivot all others are held against; registers give a collision-corrected estimate, and what
passes is confirmed on full sets. Buckets that lie in one component by then are done. In large ones that do not,
sets that share a rare shingle are held together, and counts of common shingles rule out most other pairs. Then
further pivots, four times as many each round, are held against the members of other components that are still
possible, until no pair is left. Of the buckets two sets share, only the first may pair them there.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from pertmatrix.llm.common import ascii_lower, let, words
from pertmatrix.llm.components import components
from pertmatrix.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

REGISTERS, BAND = 256, 6
MANTISSA = 4
#: Chance that registers of different minima agree: the squared density of an exponential minimum times the width
#: of a register's cell (0.72 of the value on average, in 2 ** MANTISSA parts), summed over all values.
COLLISION = 0.72 * 0.25 / (1 << MANTISSA)
#: Standard deviations below the threshold up to which an estimate still goes to the full sets: a lost pair in 10 ** 8.
SIGMAS = 5.6
#: Buckets above this size are searched by rare shingles before pivots are multiplied, and a shingle of so many sets
#: at most is rare; this only chooses the way, every pair that can be linked is found.
LARGE = RARE = 32


def shingles(text: Column, width: int) -> Column:
    """array<bigint>: hashes of the distinct runs of ``width`` words; of all words where there are fewer; none without words."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))
        few = F.when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", ws)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= width, F.array_distinct(runs)).otherwise(few)

    return let(words(ascii_lower(text)), of)


def _sign(hashes, layout: int):
    """256 register bytes of an array of uint64 hashes, 2 ** layout registers to a hash function."""
    import numpy as np

    registers = 1 << layout
    turn = np.arange(REGISTERS // registers, dtype=np.uint64)[:, None]
    mixed = hashes[None, :] + (turn + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    register = turn * np.uint64(registers) + (mixed & np.uint64(registers - 1))
    keyed = np.sort(((register << np.uint64(56)) | (mixed >> np.uint64(8))).ravel())
    slot = (keyed >> np.uint64(56)).astype(np.int64)
    first = np.concatenate([[True], slot[1:] != slot[:-1]])
    least = (keyed[first] & np.uint64((1 << 56) - 1)).astype(np.int64)
    exponent = np.frexp(np.maximum(least, 1).astype(np.float64))[1]  # 1 to 56 bits long
    zeros = np.minimum(56 - exponent, 15)
    behind = np.where(exponent > MANTISSA, least >> np.maximum(exponent - 1 - MANTISSA, 0), least << np.maximum(MANTISSA + 1 - exponent, 0)) & ((1 << MANTISSA) - 1)
    out = np.zeros(REGISTERS, np.uint8)
    out[slot[first]] = np.minimum((zeros << MANTISSA | behind) + 1, 255)
    return out.tobytes()


def _bands(sign: Column) -> Column:
    """array<bigint>: the bucket keys of a signature, one for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(F.substring(sign, 1, 1), i, sign.substr(i * BAND + 2, F.lit(BAND))))


def _layouts(n: int, percent: int) -> list[int]:
    size = n.bit_length() - 1
    found = [size] + ([size + 1] if 100 * n >= percent << (size + 1) else [])
    return sorted({min(8, max(0, x - 2)) for x in found})


def _signed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    import hashlib

    import numpy as np

    for batch in batches:
        values, bounds = batch.column(1).flatten().to_numpy(), batch.column(1).offsets.to_numpy()
        bounds = bounds - bounds[0]
        sizes, prints, signatures = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            hashes = values[a:b].view(np.uint64)
            sizes.append(int(b - a))
            prints.append(hashlib.blake2b(np.sort(hashes).tobytes(), digest_size=16).digest() if b > a else None)
            signatures.append([bytes([x]) + _sign(hashes, x) for x in _layouts(int(b - a), percent)] if b > a else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.list_(pa.binary()))], names=["id", "n", "print", "signs"])


def _estimated(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        keep = []
        for mine, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            by_layout = {x[0]: x for x in mine}
            pair = next(((by_layout[y[0]], y) for y in other if y[0] in by_layout), None)
            if pair is None:
                keep.append(False)
                continue
            x, y = (np.frombuffer(s, np.uint8, offset=1) for s in pair)
            used = (x > 0) | (y > 0)
            agree = ((x == y) & used).sum() / max(1, used.sum())
            keep.append(bool((agree - COLLISION) / (1 - COLLISION) >= least))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Corpus:
    """What the rounds share: sizes and signatures of classes of equal sets, and the texts of those with bucket mates."""

    def __init__(self, classes: DataFrame, texts: DataFrame, width: int, percent: int):
        self.classes, self.texts, self.width, self.percent = classes, texts, width, percent
        p = percent / 100
        self.least = p - SIGMAS * (p * (1 - p) / REGISTERS) ** 0.5

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough: by size, by estimate, then on full sets."""
        side = self.classes.select("rid", "n", "signs")
        joined = (
            pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
            .where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        )
        least = self.least
        likely = materialized(joined.select("a", "b", "sa", "sb").mapInArrow(lambda batches: _estimated(batches, least), "a bigint, b bigint").distinct(), "near-likely")
        # only texts of pairs are shuffled; the pairs are a written table, so few of them are broadcast against all texts
        ta, tb = (self.texts.toDF(x, f"t{x}").join(likely.select(x).distinct(), x, "left_semi") for x in "ab")
        both = likely.join(tb, "b").join(ta, "a")
        sets = both.select("a", "b", shingles(F.col("ta"), self.width).alias("sa"), shingles(F.col("tb"), self.width).alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        counted = sets.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), common.alias("common"))
        return materialized(counted.where(100 * F.col("common") >= self.percent * (F.col("total") - F.col("common"))).select("a", "b"), "near-links")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (rid, root) after ``links`` (a, b) have joined components."""
    a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    between = links.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
    found = components(between).toDF("root", "_new")
    return materialized(roots.join(found, "root", "left").select("rid", F.coalesce("_new", "root").alias("root")), "near-roots")


def _mixed(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that lie in more than one component, with their root."""
    rooted = buckets.drop("root").join(roots, "rid")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("_x"), F.max("root").alias("_y"), F.count("*").alias("size")).where("_x <> _y").select("key", "size")
    return rooted.drop("size").join(open_keys, "key")


def _common_and_rare(members: DataFrame, roots: DataFrame, corpus: _Corpus) -> tuple[DataFrame, DataFrame]:
    """(members with n and common, pairs that share a rare shingle) for the rounds over large buckets.

    Among the sets in large buckets a shingle is rare if up to RARE of them have it, else common. Two of these
    sets either share a rare shingle, and are then a pair here, or share at most the smaller of their counts of
    common ones, which settles most pairs without looking at them. Members whose common shingles are too few for
    any partner leave their large buckets. In small buckets all shingles count as common.
    """
    large = members.where(F.col("size") > LARGE)
    sets = large.select("rid").distinct().join(corpus.texts.toDF("rid", "text"), "rid").select("rid", shingles(F.col("text"), corpus.width).alias("set"))
    each = sets.select("rid", F.explode("set").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1")
    held = materialized(each.join(spread, "shingle"), "near-shingles")
    common = held.where(F.col("sets") > RARE).groupBy("rid").agg(F.count("*").alias("common"))
    rare = held.where(F.col("sets") <= RARE).join(roots, "rid").select("shingle", "rid", "root")
    other = rare.toDF("shingle", "other", "other_root")
    pairs = rare.join(other, "shingle").where("rid < other AND root <> other_root").select(F.col("rid").alias("a"), F.col("other").alias("b")).distinct()

    sized = members.join(corpus.classes.groupBy("rid").agg(F.min("n").alias("n")), "rid").join(common, "rid", "left")
    counted = sized.withColumn("common", F.when(F.col("size") > LARGE, F.coalesce("common", F.lit(0))).otherwise(F.col("n")))
    return counted.where(100 * F.col("common") >= corpus.percent * F.col("n")), pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of ``docs``.

    Documents are linked if ``100 * common >= percent * united`` shingles; component_id is the smallest id that
    links reach, and the document with that id is kept. Candidates come from bands, which miss a pair at the
    threshold with a chance of about 3 in 10 ** 6 and more similar ones far more rarely; every link is confirmed on
    full sets. Null texts and texts without words have no shingles and no links. Rows with the same id are one
    document, linked through each of its texts, and lie in one component. Rows without an id cannot be named: they have a null component
    and are kept. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = rows.select("id", shingles(F.col("text"), width).alias("set")).mapInArrow(
        lambda batches: _signed(batches, percent), "id bigint, n bigint, print binary, signs array<binary>"
    )
    signed = materialized(signed, "near-signed")
    classes = materialized(
        signed.where("n > 0 AND id IS NOT NULL").groupBy("print").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("signs").alias("signs"))
        .withColumn("rid", F.monotonically_increasing_id()), "near-classes",
    )
    # ids with more than one set, the empty one included; their sets are linked as sets of one document
    a_print = F.coalesce("print", F.lit(b""))
    several = materialized(
        signed.where("id IS NOT NULL").groupBy("id").agg(F.min(a_print).alias("_x"), F.max(a_print).alias("_y")).where("_x <> _y").select("id", F.col("_y").alias("other")), "near-several"
    )
    prints = classes.select("print", "rid")
    same_id = signed.where("print IS NOT NULL").select("id", "print").join(several, "id").where("print <> other").select("print", "other").distinct()
    own_links = materialized(same_id.join(prints.toDF("print", "a"), "print").join(prints.toDF("other", "b"), "other").select("a", "b"), "near-own-links")
    # every key of a set, in the same order in all sets: by layout, then by band
    keys = F.flatten(F.transform("signs", _bands))
    keyed = classes.select("rid", F.explode(keys).alias("key"))
    crowded = keyed.groupBy("key").agg(F.min("rid").alias("_x"), F.max("rid").alias("_y"), F.count("*").alias("size")).where("_x <> _y").select("key", "size")
    buckets = materialized(keyed.join(crowded, "key"), "near-buckets")
    weights = buckets.groupBy("rid").agg(F.sum("size").alias("weight"))
    active = materialized(weights, "near-active")
    buckets = buckets.join(active, "rid")
    wanted = active.select("rid")
    # an id with several sets gives each of them all its texts: links found by the others are links of the same document
    texts = materialized(rows.join(classes.select("rid", F.col("least").alias("id")).join(wanted, "rid", "left_semi"), "id").select("rid", "text"), "near-texts")
    corpus = _Corpus(classes, texts, width, percent)

    central = F.struct(F.col("weight"), (-F.col("rid")).alias("r"))
    pivots = buckets.groupBy("key").agg(F.max_by("rid", central).alias("a"))
    pairs = buckets.join(pivots, "key").where("rid <> a").select("a", F.col("rid").alias("b")).distinct()
    linked = wanted.union(own_links.select("a")).union(own_links.select("b")).distinct()
    roots = _merged(linked.select("rid", F.col("rid").alias("root")), corpus.links(pairs).union(own_links))

    members = materialized(_mixed(buckets, roots), "near-mixed")
    members, pairs = _common_and_rare(members, roots, corpus)
    roots = _merged(roots, corpus.links(pairs))
    members = materialized(_mixed(members, roots), "near-open")
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "rid"))).drop("root")
    ranked = materialized(ranked.join(classes.select("rid", keys.alias("keys")), "rid"), "near-ranked")
    done, more = 0, 4
    while not ranked.isEmpty():
        now = ranked.drop("size").join(roots, "rid")
        some = now.where((F.col("rank") > done) & (F.col("rank") <= done + more)).select("key", F.col("rid").alias("a"), F.col("rank").alias("_rank"), F.col("root").alias("_root"), F.col("n").alias("_n"), F.col("common").alias("_common"), F.col("keys").alias("_keys"))
        most = F.least("common", "_common")
        able = 100 * most >= percent * (F.col("n") + F.col("_n") - most)
        first = F.get(F.array_intersect("keys", "_keys"), F.lit(0)) == F.col("key")
        pairs = now.join(some, "key").where("rank > _rank AND root <> _root").where(able & first).select(F.least("a", "rid").alias("a"), F.greatest("a", "rid").alias("b"))
        roots = _merged(roots, corpus.links(pairs))
        done, more = done + more, 4 * more
        left = _mixed(ranked, roots)
        unfinished = left.groupBy("key").agg(F.max("rank").alias("_last")).where(F.col("_last") > done + 1).select("key")
        ranked = materialized(left.join(unfinished, "key", "left_semi").drop("root"), "near-ranked")

    rooted = classes.select("print", "rid", "least").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = signed.select("id", "n", "print").join(rooted.join(smallest, "root").select("print", "component"), "print", "left")
    each = named.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
    if not several.isEmpty():  # rows without shingles lie where their id's other rows do
        each = materialized(each, "near-each")
        of_id = each.join(several.select("id"), "id", "left_semi").groupBy("id").agg(F.min("component").alias("_least"))
        each = each.join(of_id, "id", "left").withColumn("component", F.coalesce("_least", "component"))
    return each.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )
