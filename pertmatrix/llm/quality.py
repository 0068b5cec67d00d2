"""Quality rules as weak supervision, native.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Expectation-maximisation on the counts of
vote patterns estimates how often each rule is right, and the posterior probability of good decides, instead
of a demand that all rules pass. There are at most 3 ** rules patterns however many documents there are, so
their counts are all that reaches the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.llm.common import BLANKS, let, words
from pertmatrix.session import materialized

#: Fixed by the contract: symbols that are counted.
SYMBOLS = "#*$%&|<>"
#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with it for in is was as on by an "
    "der die und das ist von mit zu den nicht ein im auf "
    "le la les de et un une des est que en pour dans par "
    "el los las y del se por con una para no"
).split()


def _window_hashes(ws: Column) -> Column:
    n = F.size(ws)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(ws: Column) -> Column:
    """How many words stand in a window of three words that occurs twice or more in the text.

    Windows are sorted with their places, so equal ones are neighbours; places of windows with an equal
    neighbour are then walked in order, and each covers up to three words that the next doesn't.
    """

    def covered(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def spread(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda n, x: n + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(keyed, lambda s: let(places(s), spread)))

    return let(_window_hashes(ws), covered)


def with_base(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, named with ``prefix``.

    A null text has no words and counts zero throughout, so it fails.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return (
        docs.withColumn(f"{prefix}words", words(F.col(text_col)))
        .withColumn(f"{prefix}n_words", F.size(f"{prefix}words").cast("bigint"))
        .withColumn(f"{prefix}word_chars", F.length(F.translate(text, BLANKS, "")).cast("bigint"))
        .withColumn(f"{prefix}n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"))
        .withColumn(f"{prefix}n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
        .withColumn(f"{prefix}n_lines", F.size(lines).cast("bigint"))
        .withColumn(f"{prefix}n_repeat_words", repeated_words(F.col(f"{prefix}words")))
        .withColumn(f"{prefix}base_failed", (F.col(f"{prefix}n_words") < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words")))
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0).cast("tinyint")


def default_votes(text_col: str = "text", prefix: str = "") -> dict[str, Column]:
    """The rules' votes, from the columns that ``with_base`` makes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    c = {k: F.col(f"{prefix}{k}") for k in ("words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")}
    n = F.greatest(c["n_words"], F.lit(1))
    mean_length, symbols, repeats = c["word_chars"] / n, c["n_symbols"] / n, c["n_repeat_words"] / n
    stops = F.size(F.filter(c["words"], lambda w: w.isin(STOP_WORDS))) / n
    letters = F.greatest(F.length(F.regexp_replace(text, r"\P{L}+", "")), F.lit(1))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", "")) / letters
    ends = (F.length(text) - F.length(F.translate(text, ".", ""))) / n
    loud = (F.length(text) - F.length(F.translate(text, "!?", ""))) / n
    doubled = c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1))
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\p{Nd}.,;:'\x22()?!\s-]+", "")) / F.greatest(F.length(text), F.lit(1))
    return {
        "length": _vote(c["n_words"] >= 80, c["n_words"] < 50),
        "mean_word": _vote(mean_length.between(3.0, 8.0), (mean_length < 2.5) | (mean_length > 11.0)),
        "symbols": _vote(symbols <= 0.02, symbols > 0.2),
        "repeats": _vote(repeats <= 0.15, repeats > 0.4),
        "doubled_lines": _vote((c["n_lines"] >= 3) & (doubled <= 0.1), doubled > 0.4),
        "stop_words": _vote(stops >= 0.08, stops < 0.03),
        "capitals": _vote(capitals <= 0.15, capitals > 0.5),
        "sentences": _vote(ends.between(0.03, 0.5), ends < 0.008),
        "loud": _vote(loud <= 0.05, loud > 0.5),
        "plain": _vote(plain >= 0.98, plain < 0.9),
    }


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and how often each rule is right on good and on bad ones where it votes."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]
    rounds: int
    converged: bool = True

    def posterior(self, votes: dict[str, Column]) -> Column:
        """Probability that a document is good, given the votes; abstentions say nothing."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, vote in votes.items():
            up, down = _evidence(self.on_good[name], self.on_bad[name])
            odds = odds + F.when(vote > 0, up).when(vote < 0, down).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def _evidence(on_good: float, on_bad: float) -> tuple[float, float]:
    """Log odds of good that a vote for good and a vote for bad add."""
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def fit_votes(voted: DataFrame, names: list[str], rounds: int = 300, close: float = 1e-9) -> VoteModel:
    """Expectation-maximisation over the counts of vote patterns in all rows of ``voted`` (one vote column per name).

    A rule has an accuracy on good and one on bad documents: most rules seldom speak against good ones, and each
    sees only some kinds of bad ones. Rules are taken to be no worse than chance (the two accuracies of a rule
    sum to 1 at least), and good documents to be 5 to 95 in 100, which settles what the two classes mean.
    Estimates start from 0.99 on good, 0.2 on bad and 0.7 good; one vote of each kind is added to every count.
    Without rows the start is the result. A fit that still moves by more than ``close`` after ``rounds`` warns, and the
    model says that it has not converged.
    """
    patterns = [(tuple(r[n] for n in names), r["_n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("_n")).orderBy(*names).collect()]
    prior, good, bad = 0.7, [0.99] * len(names), [0.2] * len(names)
    done, moved = 0, 0.0
    for done in range(1, rounds + 1):
        total = held = 0.0
        # votes for good and all votes of each rule, among good and among bad documents
        counts = [[1.0, 2.0, 1.0, 2.0] for _ in names]
        evidence = [_evidence(g, b) for g, b in zip(good, bad)]
        start = math.log(prior / (1 - prior))
        for votes, n in patterns:
            odds = start + sum(e[0] if v > 0 else e[1] for v, e in zip(votes, evidence) if v)
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            total, held = total + n, held + n * p
            for c, v in zip(counts, votes):
                if v:
                    c[1] += n * p
                    c[3] += n * (1 - p)
                    if v > 0:
                        c[0] += n * p
                    else:
                        c[2] += n * (1 - p)
        if not total:
            break
        new_prior = min(0.95, max(0.05, held / total))
        new_good = [min(1 - 1e-6, max(0.5, c[0] / c[1])) for c in counts]
        new_bad = [min(0.999, max(c[2] / c[3], 1 - g)) for c, g in zip(counts, new_good)]
        moved = max(abs(x - y) for x, y in zip([new_prior, *new_good, *new_bad], [prior, *good, *bad]))
        prior, good, bad = new_prior, new_good, new_bad
        if moved < close:
            break
    if moved >= close:
        warnings.warn(f"expectation-maximisation still moves by {moved:.1e} after {done} rounds", stacklevel=2)
    return VoteModel(prior, dict(zip(names, good)), dict(zip(names, bad)), done, moved < close)


def judge_quality(docs: DataFrame, text_col: str = "text", least: float = 0.5, prefix: str = "_q_", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all without it), then with ``prefix``: base counts, votes, base_failed, posterior, kept.

    A document is kept if the base rules pass and the posterior is at least ``least``. Null and empty texts
    fail the base rules. The model is fitted on the votes on all rows, repeated ones included; equal texts get
    equal verdicts. Texts are looked at once: counts and votes are written with the carried columns, and the
    model and the verdicts come from there. Columns of ``docs`` that begin with ``prefix`` are not allowed.
    """
    if clash := [c for c in docs.columns if c.startswith(prefix)]:
        raise ValueError(f"columns {clash} begin with the prefix {prefix!r}; choose another prefix")
    votes = default_votes(text_col, prefix)
    names = {k: f"{prefix}vote_{k}" for k in votes}
    counted = with_base(docs, text_col, prefix).withColumns({names[k]: v for k, v in votes.items()}).drop(f"{prefix}words")
    own = [c for c in counted.columns if c.startswith(prefix)]
    judged = materialized(counted.select(*(docs.columns if carry is None else carry), *own), "quality-votes")
    model = fit_votes(judged.select(*names.values()), list(names.values()))
    posterior = model.posterior({c: F.col(c) for c in names.values()})
    kept = ~F.col(f"{prefix}base_failed") & (F.col(f"{prefix}posterior") >= least)
    return judged.withColumn(f"{prefix}posterior", posterior).withColumn(f"{prefix}kept", kept)
