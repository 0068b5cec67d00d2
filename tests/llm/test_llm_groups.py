"""Conversation repair, spelling variants and line dedup against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from pertmatrix.llm import line_dedup, spelling, turn_repair
from pertmatrix.llm.queries import damaged_turns, misspelt

BLANKS = " \t\n\x0b\x0c\r"


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ordered(rows):
    return sorted(rows, key=repr)


# 11 -----------------------------------------------------------------------------------------------------------------


def cheapest(turns):
    """Shortest path over (turns read, roles so far as far as they matter), by cost, then by the audit's letters."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, last = heapq.heappop(heap)
        if (k, last, "end") in done:
            continue
        if k == len(turns) and last in ("", "a"):
            return cost, audit
        done.add((k, last, "end"))
        for new in after[last]:
            if new != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", k, new))
        if k < len(turns):
            initial, gone, cut = turns[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, last))
            for new in after[last] if not gone else ():
                if new == initial:
                    heapq.heappush(heap, (cost + cut, audit + "K", k + 1, new))
                elif new != "s":
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", k + 1, new))
    raise AssertionError


def test_repair_against_shortest_paths():
    repairer = turn_repair.Repairer()
    kinds = [(i, False, c) for i in ("s", "u", "a", "") for c in (False, True)] + [("u", True, False)]
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert repairer.repair(turns) == cheapest(turns)
    rng = random.Random(11)
    for n in (7, 12, 40):
        for _ in range(60):
            turns = rng.choices(kinds, k=n)
            assert repairer.repair(turns) == cheapest(turns)
    assert len(repairer.steps) < 10_000


def test_repair_of_a_very_long_conversation_is_linear():
    cost, audit = turn_repair.Repairer().repair([("u", False, False)] * 200_000)
    assert cost == 200_000 and len(audit) >= 200_000
    assert turn_repair.Repairer().repair([("u", False, False)] * 9) == cheapest([("u", False, False)] * 9)


def brute_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, tokens, faults = set(), [], Counter()
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        tokens.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    numbers = {r[0] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tokens, tokens[1:]))
    cost, audit = cheapest(tokens)
    lines, left, led = [], iter(rows), 0
    for edit in audit:
        _, role, text = next(left) if edit != "I" else (None, "", "")
        if edit == "D":
            continue
        if edit == "K":
            led = led or int(not lines and role[:1] == "s")
        else:
            role = "user" if (len(lines) - led) % 2 == 0 else "assistant"
        lines.append(f"{role}:{text}")
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


def test_conversations_against_plain_python(spark, small_batches):
    rng = random.Random(12)
    texts = ["Hi.", "Hi", "", " \t", "Yes! ", "é?\n", "What:\nthen.", None, "\xa0"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "use:r"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts), "x", "y") for _ in range(400)]
    rows += [(99, k, "ua"[k % 2] + "x", f"{k}." if k % 7 else "cut", "x", "y") for k in range(300)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, conv string")
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn, role or "", text or ""))
    done = turn_repair.repair_turns(table)
    digests = {r["conv"]: r["digest"] for r in done.digests().collect()}
    got = {r["conv"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], digests.get(r["conv"])) for r in done.verdicts.collect()}
    assert got == {conv: brute_conversation(x) for conv, x in groups.items()}
    empty = turn_repair.repair_turns(table.limit(0))
    assert empty.verdicts.count() == empty.turns.count() == empty.digests().count() == 0


def test_very_long_turns(spark):
    long = "long " * 400_000 + "end."
    table = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)], "conv_id bigint, turn bigint, role string, text string")
    done = turn_repair.repair_turns(table)
    assert done.verdicts.select("duplicate", "cost", "audit").first() == (1, 3, "KKD")
    assert done.digests().first()["digest"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "a. b? c") for c in (None, *range(60)) for t in (None, 0, 1)]
    got = Counter((r["conv_id"], r["turn"], r["role"], r["text"]) for r in damaged_turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if d == 4 else role, {1: "", 2: "a b c"}.get(d, text)] += {0: 0, 3: 2}.get(d, 1)
    assert got == +want


# 12 -----------------------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_groups(counts):
    by_rest = defaultdict(set)
    for w in counts:
        for rest in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_rest[rest].add(w)
    mates = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            mates[a] |= {b for b in group if near(a, b)}
    forms = {}
    for w, n in counts.items():
        top = min(mates[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = top if top is not None and counts[top] >= 5 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(mates[w]), counts.get(forms[w])))
    return ordered(out)


@pytest.mark.parametrize("large", [2, 8, 64])
def test_spelling_groups_against_all_pairs(spark, monkeypatch, large):
    monkeypatch.setattr(spelling, "LARGE", large)
    rng = random.Random(13)
    counts = {}
    for letters, size, times in (("ab", 8, 200), ("abcdeé", 6, 500), ("thionr", 11, 100), ("ÿàx×", 9, 60)):
        for _ in range(times):
            word = "".join(rng.choices(letters, k=size + rng.randint(-2, 2)))
            for variant in (word, word[1:], word[:-1], word + "z", word[:3] + "q" + word[3:], word[:2] + "é" + word[3:]):
                if len(variant) >= 4:
                    counts[variant] = 5 ** rng.randint(0, 6) + rng.randint(0, 2)
    counts |= {"x" * 5000: 5, "x" * 4999: 30, "x" * 2500 + "y" + "x" * 2499: 5}
    table = spark.createDataFrame([(w, n, "z") for w, n in counts.items()], "word string, n bigint, form string")
    got = [tuple(r) for r in spelling.spelling_groups(table).collect()]
    assert ordered(got) == brute_groups(counts)


def test_spelling_of_nothing(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_pivots_are_disjoint_and_rare():
    rng = random.Random(14)
    words = {"".join(rng.choices("abcd", k=rng.randint(4, 12))) for _ in range(300)}
    sets = Counter(g for w in words for g in {w[k : k + 2] for k in range(len(w) - 1)})
    order = {g: (n, g) for g, n in sets.items()}
    for w in words:
        prefix, (p, q) = spelling.prefix_and_pivots(w, order)
        three = sorted(range(len(w) - 1), key=lambda k: (order[w[k : k + 2]], k))[:3]
        assert {p, q} <= set(three) <= set(prefix) and q - p >= 2
        assert sets[w[p : p + 2]] + sets[w[q : q + 2]] == min(sets[w[a : a + 2]] + sets[w[b : b + 2]] for a in three for b in three if b - a >= 2)


def test_word_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 40)
    monkeypatch.setattr(spelling, "WORDS", 10)
    rng = random.Random(15)
    words = ["Thought", "thought", "ÀRBRES", "àrbres", "naïveté", "short", "x" * 90, "don't", "über×über", "snake_case_word", "ʼapostrophe", "études"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", ".", "\n"])) for i in range(300)]
    rows += [(None, "Thought nothing"), (7, None), (8, ""), (9, "x" * 5000), (9, "x" * 5000)]
    want = Counter()
    for own, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = misspelt(own, "".join(c.lower() if "A" <= c <= "Z" else c for c in run))
            if len(word) >= 6:
                want[word] += 1
    table = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id bigint, text string, word string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(table, respell=misspelt).collect()} == dict(want)
    assert spelling.word_counts(table.limit(0)).count() == 0


# 13 -----------------------------------------------------------------------------------------------------------------


def brute_lines(rows, least_chars, least_docs):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (len(holders[key(x)]) >= least_docs and i != max(holders[key(x)], key=rank))]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return ordered(out)


@pytest.mark.parametrize("least_docs", [2, 3])
def test_lines_against_plain_python(spark, small_batches, least_docs):
    rng = random.Random(16)
    pool = [f"Line number {k} of some length" for k in range(25)] + ["short", "", "  ", "É" * 20, "é" * 20, "\x1cx" * 12, "exactly twenty chars"]
    rows = []
    for i in range(120):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", "\r"]) for x in rng.choices(pool, k=rng.randint(0, 9))]
        rows.append((rng.choice([i, i, i, i - 1, None]), "\n".join([*lines, f"own line of document {i}, long", "A line that every document holds"])))
    rows += rows[:20] + [(500, None), (501, ""), (502, "\n\n"), (503, "A LINE that every document holds\n" * 4000), (-1, "x" * 300_000)]
    table = spark.createDataFrame([(i, t, "k", b"") for i, t in rows], "doc_id bigint, text string, key string, print binary")
    bitmaps = line_dedup.line_bitmaps(table, least_chars=20, least_docs=least_docs)
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.without_lines(table, bitmaps).collect()]
    assert ordered(got) == brute_lines(rows, 20, least_docs)
    assert bitmaps.where("n_dropped = 0").count() == 0


def test_lines_of_an_empty_table(spark):
    table = spark.createDataFrame([], "doc_id bigint, text string")
    assert line_dedup.without_lines(table, line_dedup.line_bitmaps(table)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.line_bitmaps(table, least_docs=1)
