"""Secret scans with a random forest against false positives, native.

Candidates are values in a format that only secrets have, wherever they stand, and other long runs of key
characters with a digit. Their features (length, changes between kinds of characters, dictionary coverage, path,
neighbouring words) go to a random forest that was trained on labelled findings. The forest is turned into column expressions, so a scan is one pass over the
texts without a shuffle, and every row is judged in its place.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.llm.common import let, words
from pertmatrix.session import materialized

SHORTEST = 12
#: So many characters before and behind a value are looked at; a word can be a whole file without blanks.
NEAR = 64
#: Formats that only secrets have.
FORMATS = (
    r"A(?:KI|SI)A[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36,}", r"xox[abprs]-[0-9A-Za-z-]{10,}", r"AIza[0-9A-Za-z_-]{35}",
    r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", r"glpat-[0-9A-Za-z_-]{20,}", r"eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+",
)
#: A format wherever no letter or digit touches it, but for an escaped sign before it.
_ANYWHERE = r"(?:(?<![0-9A-Za-z])|(?<=%[0-9A-Fa-f]{2})|(?<=\\[bfnrt])|(?<=\\u[0-9A-Fa-f]{4}))(?:" + "|".join(FORMATS) + ")(?![0-9A-Za-z])"
#: Words beside a secret, and words beside numbers that are none.
KEY_WORDS = r"(?i)passw|passphrase|\bpwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth"
PLAIN_WORDS = r"(?i)order|invoice|phone|\btel|isbn|issn|card|iban|commit|version|build|page|serial|tracking|figure|uuid|checksum"
#: Words that make up names and placeholders rather than keys.
DICTIONARY = (
    "the and for with from this that test example sample demo dummy default placeholder changeme change user name admin root value "
    "string number image file page home index main data info date time year month day version release build local host server client "
    "public static content upload download media image photo video audio document report table chapter section part order product "
    "item list menu search result news blog post article comment about contact help support http https www com org net html php"
).split()

#: A long run of key characters, without full stops at its end if it is long enough without them.
_RUN = r"[A-Za-z0-9+/_~.-]{%d,}[A-Za-z0-9+/_~-]|[A-Za-z0-9+/_~.-]{%d,}" % (SHORTEST - 1, SHORTEST)
_PATH = r"://|^[./~]"
#: What can lie between the start of an address or path and a value in it.
_SAME = r"[^\x22'`(),;<>\[\]{}|]*"
FEATURES = (
    "length", "digits", "capitals", "small", "signs", "changes", "distinct", "longest_run", "dictionary", "hexadecimal", "path", "dots", "quoted", "key_word", "plain_word",
)


def _pieces(word: Column) -> Column:
    """Fixed formats and long runs of key characters of a word at odd places; what lies around them at even ones."""
    outer = F.split(F.regexp_replace(word, _ANYWHERE, "\n$0\n"), "\n")

    def rest(piece: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.array(piece)).otherwise(F.split(F.regexp_replace(piece, _RUN, "\n$0\n"), "\n"))

    return F.flatten(F.transform(outer, rest))


def _is_format(value: Column) -> Column:
    return value.rlike("^(?:" + "|".join(FORMATS) + ")$")


def _features(word: Column, value: Column, own: Column, beside: Column) -> Column:
    n = F.length(value).cast("double")

    def share(kinds: str) -> Column:
        return F.length(F.regexp_replace(value, rf"[^{kinds}]+", "")) / n

    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    runs = F.filter(F.split(F.regexp_replace(kinds, r"(?<=(.))(?!\1)", " "), " "), lambda r: r != "")
    known = "|".join(w for w in DICTIONARY if len(w) >= 3)
    flags = [value.rlike(r"^[0-9a-fA-F]+$"), own.rlike(_PATH) | (F.length(own) - F.length(F.translate(own, "/", "")) >= 2), F.lit(None), word.rlike(r"[\x22'`]"), beside.rlike(KEY_WORDS), beside.rlike(PLAIN_WORDS)]
    number = [f.cast("double") for f in flags]
    number[2] = (n - F.length(F.translate(value, ".", ""))) / n
    return F.array(
        n, share("0-9"), share("A-Z"), share("a-z"), 1 - share("A-Za-z0-9"),
        (F.size(runs) - 1) / n, F.size(F.array_distinct(F.split(value, ""))) / n, F.array_max(F.transform(runs, lambda r: F.length(r))) / n,
        1 - F.length(F.regexp_replace(F.lower(value), known, "")) / n, *number,
    )


def candidates(text: Column) -> Column:
    """array<struct<place, part, word, value, beside, features>>: the candidates of a text by their word and part of it.

    A word has as many candidates as fixed formats and runs of key characters beside them, so text without blanks is
    judged whole and what touches a value does not hide it; full stops at the end are no part of a long run. ``word`` is the
    value with up to NEAR characters on both sides; ``beside`` is the two words before, the part of the word before
    the value, and the word behind, up to NEAR characters of each. A null text has no candidates; a long text is
    searched to its end.
    """

    def of(ws: Column) -> Column:
        def found(word: Column, place: Column) -> Column:
            around = F.struct(F.concat_ws(" ", F.right(F.get(ws, place - 2), F.lit(NEAR)), F.right(F.get(ws, place - 1), F.lit(NEAR))).alias("a"), F.left(F.get(ws, place + 1), F.lit(NEAR)).alias("b"))

            def parts(x: Column) -> Column:
                pieces, words_beside = x["pieces"], x["around"]

                def part(value: Column, i: Column) -> Column:
                    before = F.right(F.concat(F.coalesce(F.get(pieces, i - 2), F.lit("")), F.get(pieces, i - 1)), F.lit(NEAR))
                    behind = F.left(F.get(pieces, i + 1), F.lit(NEAR))
                    fits = (i % 2 == 1) & (value.rlike("[0-9]") | _is_format(value))
                    return F.when(
                        fits,
                        F.struct(
                            place.alias("place"), F.floor(i / 2).cast("int").alias("part"), F.concat(before, value, behind).alias("word"), value.alias("value"),
                            F.concat(F.regexp_extract(before, _SAME + "$", 0), value, F.regexp_extract(behind, "^" + _SAME, 0)).alias("own"),
                            F.concat_ws(" ", words_beside["a"], before, words_beside["b"]).alias("beside"),
                        ),
                    )

                return F.filter(F.transform(pieces, part), lambda c: c.isNotNull())

            whole = F.struct(_pieces(word).alias("pieces"), around.alias("around"))
            return F.when((F.length(word) >= SHORTEST) & word.rlike("[0-9]|" + "|".join(FORMATS)), let(whole, parts))

        return F.flatten(F.filter(F.transform(ws, found), lambda c: c.isNotNull()))

    return F.transform(
        let(words(text), of),
        lambda c: F.struct(*[c[n].alias(n) for n in ("place", "part", "word", "value", "beside")], _features(c["word"], c["value"], c["own"], c["beside"]).alias("features")),
    )


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` (value, word, beside, features) with ``label``: what a reviewer's rules settle, 1 or 0, else null.

    Formats that only secrets have, and mixed values beside a key word, are secrets. Plain numbers, values of a
    few different characters or of dictionary words, UUIDs and paths are not. Give findings labelled by people
    instead where there are any: ``fit_forest`` takes every table of (features, label).
    """
    f = {n: F.col("features")[k] for k, n in enumerate(FEATURES)}
    mixed = (f["digits"] > 0) & (f["digits"] < 1) & (f["distinct"] * f["length"] >= 7) & (f["dictionary"] < 0.4)
    plain = (f["digits"] == 1) | (f["distinct"] * f["length"] <= 4) | (f["dictionary"] >= 0.5)
    uuid = F.col("value").rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    keyed = (f["key_word"] == 1) & mixed
    return found.withColumn("label", F.when(_is_format(F.col("value")), 1).when(plain, 0).when(keyed, 1).when(uuid | (f["path"] == 1), 0).cast("double"))


@dataclass(frozen=True)
class Forest:
    """Trees as nested (feature, threshold, at most, above), leaves as the class."""

    trees: tuple

    def probability(self, features: Column) -> Column:
        """Share of trees that say secret."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, low, high = node
            return F.when(F.get(features, F.lit(feature)) <= F.lit(threshold), walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + walk(tree)
        return total / len(self.trees)


def _parse(text: str) -> tuple:
    """The trees in the printed form of a fitted forest."""
    step = re.compile(r"(If|Else) \(feature (\d+) (?:<=|>) (\S+)\)|Predict: (\S+)")

    def node(lines):
        m = step.search(next(lines))
        if m[4]:
            return float(m[4])
        low = node(lines)
        next(lines)  # the matching Else
        return int(m[2]), float(m[3]), low, node(lines)

    return tuple(node(iter([x for x in part.splitlines()[1:] if x.strip()])) for part in re.split(r"(?=Tree \d+ \()", text)[1:])


def fit_forest(labelled: DataFrame, sample: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 1, held_out: Sequence[str] = ()) -> Forest | None:
    """A forest from (features, label); null labels are left out.

    At most ``sample`` different findings of each label take part, those with the smallest hashes, so the fit costs
    the same at every size and copies of a document count once. No tree looks at the features ``held_out``, for labels made by rules on these. None if there are not both labels.
    """
    known = labelled.where(F.col("label").isNotNull()).select("features", "label").distinct()
    drawn = [known.where(F.col("label") == x).orderBy(F.xxhash64("features"), "features").limit(sample) for x in (0.0, 1.0)]
    train = materialized(drawn[0].unionByName(drawn[1]).coalesce(1), "secret-findings")
    if train.select(F.countDistinct("label")).first()[0] < 2:
        return None
    shown = F.transform("features", lambda x, i: F.when(i.isin([FEATURES.index(n) for n in held_out]), 0.0).otherwise(x)) if held_out else F.col("features")
    rows = train.select(array_to_vector(shown).alias("features"), "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)
    return Forest(_parse(model.toDebugString))


def scan(
    docs: DataFrame, forest: Forest | None = None, text_col: str = "text", least: float = 0.5, column: str = "findings", carry: list[str] | None = None, **fit
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all without it) and ``column``: each row's findings.

    A finding is a candidate as struct<place, part, value, probability, secret>. Without a ``forest``, one is fitted
    on the candidates of ``docs`` that ``label_findings`` settles, with ``fit`` for ``fit_forest``. A candidate is a
    secret if at least the share ``least`` of the trees says so. The fixed formats are always secrets, and are
    the only ones where there are no labelled findings of both kinds to fit a forest on. Null and empty texts have no candidates.
    All rows stay as they are; ``column`` must not be one of theirs. Texts are searched once: candidates are
    written with the carried columns, and the forest and the verdicts come from there.
    """
    if column in docs.columns:
        raise ValueError(f"there is a column {column!r}; choose another name")
    kept = docs.columns if carry is None else carry
    found = materialized(docs.select(*kept, candidates(F.col(text_col)).alias(column)), "secret-candidates")
    if forest is None:
        forest = fit_forest(label_findings(found.select(F.explode(column).alias("c")).select("c.*")), **fit)

    def judged(c: Column) -> Column:
        p = F.when(_is_format(c["value"]), 1.0).otherwise(F.lit(0.0) if forest is None else forest.probability(c["features"]))
        return F.struct(c["place"].alias("place"), c["part"].alias("part"), c["value"].alias("value"), p.alias("probability"))

    with_p = F.transform(F.col(column), judged)
    return found.withColumn(
        column, F.transform(with_p, lambda x: F.struct(*[x[n].alias(n) for n in ("place", "part", "value", "probability")], (x["probability"] >= least).alias("secret")))
    )


def redacted(text: Column, findings: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every secret of ``findings`` replaced wherever it stands, longer ones first."""
    secret = F.array_sort(F.array_distinct(F.transform(F.filter(findings, lambda x: x["secret"]), lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("v")))))
    return F.aggregate(secret, text, lambda t, s: F.replace(t, s["v"], F.lit(mark)))
