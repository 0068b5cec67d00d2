"""Conversation structure repair: generalised LR with a graph-structured stack and weighted edits.

The roles of a conversation must be a sentence of a small grammar. Its LR automaton runs on all edits at once: each
turn may be kept, rerolled or deleted, and turns may be inserted before it. Stacks share their lower parts as nodes
of one graph (a state and the node below it, made once), and stacks with the same top are merged by the minimum of
(cost, audit), the audit being the initials of the edits. Turns are only inserted before a turn that is read, or at
the end, so no audit of the same turns begins another and the merge keeps the least audit of the whole as well.

A set of stacks with their costs against the cheapest and their order by audit is one of few, so steps between such
sets are looked up after their first time; a turn then costs one lookup and a byte or two for each stack.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from pertmatrix.llm.common import BLANKS
from pertmatrix.session import materialized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Role initials: an optional system turn, then pairs of user and assistant; or nothing.
GRAMMAR = (("conversation", ()), ("conversation", ("pairs",)), ("conversation", ("s", "pairs")), ("pairs", ("u", "a")), ("pairs", ("pairs", "u", "a")))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
END = ""
#: How many different steps a task remembers.
STEPS = 1 << 16


@dataclass(eq=False)
class Stack:
    """A node of the graph: a state on the stack ``below``; ``moves`` and ``tops`` are filled as they are needed."""

    state: frozenset
    below: Stack | None
    moves: dict = field(default_factory=dict)
    tops: dict = field(default_factory=dict)


class Automaton:
    """SLR(1) steps of a grammar. The first rule's left side is the start symbol."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = grammar
        self.heads = {head for head, _ in grammar}
        self.start = grammar[0][0]
        self.follow = self._follow()
        self.bottom = Stack(self._closure({(k, 0) for k, (head, _) in enumerate(grammar) if head == self.start}), None)

    def _closure(self, items: set) -> frozenset:
        found, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            if dot < len(body):
                new = {(k, 0) for k, (head, _) in enumerate(self.rules) if head == body[dot]} - found
                found |= new
                todo.extend(new)
        return frozenset(found)

    def _follow(self) -> dict:
        """What may come after a symbol; the grammar's only empty rule is the start symbol's own."""
        follow = {head: set() for head in self.heads}
        follow[self.start].add(END)

        def firsts(symbol, seen=()):
            if symbol not in self.heads:
                return {symbol}
            return {x for head, body in self.rules if head == symbol and body and symbol not in seen for x in firsts(body[0], (*seen, symbol))}

        changed = True
        while changed:
            before = sum(map(len, follow.values()))
            for head, body in self.rules:
                for k, symbol in enumerate(body):
                    if symbol in self.heads:
                        follow[symbol] |= firsts(body[k + 1]) if k + 1 < len(body) else follow[head]
            changed = sum(map(len, follow.values())) > before
        return follow

    def _push(self, stack: Stack, symbol: str) -> Stack | None:
        if symbol not in stack.tops:
            items = {(rule, dot + 1) for rule, dot in stack.state if self.rules[rule][1][dot : dot + 1] == (symbol,)}
            stack.tops[symbol] = Stack(self._closure(items), stack) if items else None
        return stack.tops[symbol]

    def read(self, stack: Stack, terminal: str) -> Stack | None:
        """The stack after ``terminal``, reductions done before and after it where nothing else can come; None: an error.

        At the end of the input, the stack itself if all of it is a sentence.
        """
        if terminal in stack.moves:
            return stack.moves[terminal]
        now = stack
        while now is not None:
            done = next((r for r, dot in now.state if dot == len(self.rules[r][1]) and terminal in self.follow[self.rules[r][0]]), None)
            if done is None:
                now = self._push(now, terminal) if terminal != END else None
                break
            head, body = self.rules[done]
            for _ in body:
                now = now.below
            if head == self.start:
                now = stack if now is self.bottom else None
                break
            now = self._push(now, head)
        if now is not None and now is not stack:
            now = self._settled(now)
        stack.moves[terminal] = now
        return now

    def _settled(self, stack: Stack) -> Stack:
        """Reductions that any next symbol asks for, so that stacks with the same future have the same top."""
        while len(stack.state) == 1:
            ((rule, dot),) = stack.state
            head, body = self.rules[rule]
            if dot < len(body) or head == self.start:
                break
            for _ in body:
                stack = stack.below
            stack = self._push(stack, head)
        return stack


class Repairer:
    """Cheapest repairs of sequences of turns. A turn is (initial, must go, truncated)."""

    def __init__(self, automaton: Automaton | None = None):
        self.automaton = automaton or Automaton()
        self.inserts = tuple(sorted(ROLES))
        self.steps: dict = {}
        self.ends: dict = {}

    def _with_inserts(self, live: tuple) -> dict:
        """stack -> (cost, order, letters, origin): each live stack, alone or after inserted turns."""
        best = {stack: (cost, k, "", k) for k, (stack, cost) in enumerate(live)}
        todo = list(best)
        while todo:
            stack = todo.pop()
            cost, order, letters, origin = best[stack]
            for terminal in self.inserts:
                top = self.automaton.read(stack, terminal)
                new = (cost + INSERT, order, letters + "I", origin)
                if top is not None and (top not in best or new < best[top]):
                    best[top] = new
                    todo.append(top)
        return best

    def step(self, live: tuple, turn: tuple) -> tuple[tuple, int, tuple]:
        """(stacks after the turn, what the cheapest cost more, (origin, letters) of each stack).

        ``live`` holds (stack, cost above the cheapest) in the order of their audits, which is all that tells audits apart.
        """
        known = self.steps.get((live, turn))
        if known is not None:
            return known
        initial, must_go, truncated = turn
        best: dict = {}

        def offer(top, value):
            if top is not None and (top not in best or value < best[top]):
                best[top] = value

        for stack, (cost, order, letters, origin) in self._with_inserts(live).items():
            offer(stack, (cost + DELETE, order, letters + "D", origin))
            if must_go:
                continue
            cost += TRUNCATED * truncated
            offer(self.automaton.read(stack, initial) if initial else None, (cost, order, letters + "K", origin))
            for terminal in self.inserts:
                offer(self.automaton.read(stack, terminal), (cost + REROLE, order, letters + "R", origin))
        least = min(v[0] for v in best.values())
        ordered = sorted(best.items(), key=lambda x: x[1][1:3])
        out = tuple((stack, v[0] - least) for stack, v in ordered), least, tuple((v[3], v[2]) for _, v in ordered)
        if len(self.steps) >= STEPS:
            self.steps.clear()
        self.steps[live, turn] = out
        return out

    def start(self) -> tuple:
        return ((self.automaton.bottom, 0),)

    def end(self, live: tuple) -> tuple:
        """(cost, order, letters, origin) of the cheapest way from ``live`` to the end."""
        known = self.ends.get(live)
        if known is None:
            if len(self.ends) >= STEPS:
                self.ends.clear()
            known = self.ends[live] = min(v for stack, v in self._with_inserts(live).items() if self.automaton.read(stack, END) is not None)
        return known

    def repair(self, turns) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, the ASCII-least audit among equally cheap ones."""
        live, cost, back = self.start(), 0, []
        for turn in turns:
            live, more, origins = self.step(live, turn)
            cost += more
            back.append(origins)
        more, _, letters, at = self.end(live)
        parts = [letters]
        for origins in reversed(back):
            at, letters = origins[at]
            parts.append(letters)
        return cost + more, "".join(reversed(parts))


def _sorted(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions("conv", *order)


def _last(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def _judged(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One verdict for each conversation of sorted turns (conv, turn, initial, print, blank, cut)."""
    repairer = Repairer()
    names = ["conv", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    legal = {"su", "ua", "au"}
    out: list[tuple] = []
    conv, any_yet, seen, tokens, numbers = None, False, set(), [], [0] * 5
    first = last = before = None

    def ended():
        cost, audit = repairer.repair(tokens)
        gaps = 0 if first is None else last - first + 1 - numbers[4]
        out.append((conv, len(tokens), gaps, *numbers[:4], cost, audit))

    def told():
        columns = zip(*out) if out else ((),) * 9
        kinds = [conv_type, *[pa.int64()] * 7, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    for batch in batches:
        for this, turn, initial, mark, blank, cut in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if not any_yet or this != conv:
                if any_yet:
                    ended()
                conv, any_yet, seen, tokens, numbers = this, True, set(), [], [0] * 5
                first = last = before = None
            if turn is not None and turn != last:
                first, last = turn if first is None else first, turn
                numbers[4] += 1
            again = mark in seen
            seen.add(mark)
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                numbers[fault] += 1
            if before is not None and before + initial not in legal:
                numbers[3] += 1
            before = initial
            tokens.append((initial if initial in ("s", "u", "a") else "", fault in (0, 1), fault == 2))
        yield told()
        out.clear()
    if any_yet:
        ended()
        yield told()


def _repaired(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Turns (conv, audit, role, text), each conversation led by a row with its audit -> repaired turns."""
    convs, places, edits, roles, texts, size = [], [], [], [], [], 0
    names = ["conv", "place", "edit", "role", "text"]
    conv, audit, at, place, system = None, "", 0, 0, False

    def told():
        kinds = (conv_type, pa.int64(), pa.string(), pa.string(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((convs, places, edits, roles, texts), kinds)], names=names)
        for x in (convs, places, edits, roles, texts):
            x.clear()
        return batch

    def put(edit, role, text):
        nonlocal place, system, size
        size += len(text) + 64
        if edit in "IR":
            role = ROLES["ua"[(place - system) % 2]]
        elif place == 0:
            system = role[:1] == "s"
        convs.append(conv), places.append(place), edits.append(edit), roles.append(role), texts.append(text)
        place += 1

    def inserts():
        nonlocal at
        while audit[at : at + 1] == "I":
            put("I", "", "")
            at += 1

    for batch in batches:
        for k in range(batch.num_rows):
            this, plan, role, text = (batch.column(c)[k].as_py() for c in range(4))
            if plan is not None:
                inserts()  # at the end of the conversation before
                conv, audit, at, place, system = this, plan, 0, 0, False
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                put(edit, role, text)
            if size > 1 << 22:
                yield told()
                size = 0
    inserts()
    yield told()


def _lines_digest(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    conv, digest, convs, digests = None, None, [], []

    def told():
        batch = pa.RecordBatch.from_arrays([pa.array(convs, conv_type), pa.array(digests, pa.string())], names=["conv", "digest"])
        convs.clear(), digests.clear()
        return batch

    for batch in batches:
        for k in range(batch.num_rows):
            this, place, role, text = (batch.column(c)[k].as_py() for c in (0, 1, 3, 4))
            if place == 0:
                if digest is not None:
                    convs.append(conv), digests.append(digest.hexdigest())
                conv, digest = this, hashlib.sha256()
            digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        yield told()
    if digest is not None:
        convs.append(conv), digests.append(digest.hexdigest())
        yield told()


@dataclass(frozen=True)
class Repaired:
    """``verdicts``: conv, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: conv, place, edit,
    role, text of the repaired conversations; each partition holds whole conversations in order."""

    verdicts: DataFrame
    turns: DataFrame
    conv_type: str

    def digests(self) -> DataFrame:
        """(conv, digest): sha256 of a conversation's ``role:text`` lines, for conversations with any turn left."""
        kind = pa.int64() if self.conv_type == "bigint" else pa.string()
        return self.turns.mapInArrow(lambda batches: _lines_digest(batches, kind), f"conv {self.conv_type}, digest string")


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """Faults of each conversation and its cheapest repair to the role grammar.

    A conversation's turns are taken by turn, nulls first, those of one turn by role and then by the sha256 of role
    and text. A turn's fault is the first that holds of: blank (no character but the six blanks), duplicate (role and
    text seen earlier), truncated (the last character that is no blank is none of ``.!?``). Blank and duplicate turns
    must be deleted (3); others are kept (0), rerolled to user or assistant (2) or deleted, truncated ones that stay
    cost 1 more, and empty turns of user or assistant are inserted anywhere (2). gaps are the turn numbers missing
    between the first and the last.

    Null roles and texts are empty; a role's class is its first character. Turns with a null conversation are one
    conversation. Repeated rows are duplicates. An empty table has no verdicts. Other columns are ignored. Texts are only
    streamed; a task holds one conversation's digests and a few bytes for each of its turns, and its audit, one value.
    """
    kind = dict(turns.dtypes)[conv_col]
    if kind != "string":
        kind = "bigint"
    arrow = pa.int64() if kind == "bigint" else pa.string()
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(F.col(conv_col).cast(kind).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    by_turn = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("print")]
    marked = rows.withColumn("print", F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)))
    last = _last(F.col("text"))
    narrow = marked.select("conv", "turn", "role", "print", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    ordered = _sorted(narrow, *by_turn).select("conv", "turn", F.substring("role", 1, 1).alias("initial"), "print", "blank", "cut")
    verdicts = materialized(
        ordered.mapInArrow(lambda b: _judged(b, arrow), f"conv {kind}, n_rows bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"),
        "turn-verdicts",
    )
    # a conversation's verdict goes before its turns
    plans = verdicts.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(b"").alias("print"))
    both = plans.unionByName(marked.select("conv", F.lit(1).alias("kind"), "turn", F.lit(None).cast("string").alias("audit"), "role", "text", "print"))
    fixed = _sorted(both, "kind", *by_turn).select("conv", "audit", "role", "text").mapInArrow(lambda b: _repaired(b, arrow), f"conv {kind}, place bigint, edit string, role string, text string")
    return Repaired(verdicts, fixed, kind)
