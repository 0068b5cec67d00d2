"""Leaderboard pages: boards embedded in a page's pushed payload, read from a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The payload's keys for entries and totals per board.
BOARD_KEYS = {
    "live": ("initialLiveLeaderboardEntries", "initialLiveLeaderboardNumEntries"),
    "final": ("initialFinalLeaderboardEntries", "initialFinalLeaderboardNumEntries"),
    "generalist": ("initialGeneralistEntries", "initialGeneralistNumEntries"),
}
# Scaled score columns and their raw columns.
SCORES = {
    "scorePds": "pdsCosine",
    "scoreMse": "exprMseUnbiasedCappedNorm",
    "scoreNmae": "deWilcoxonLfcNmae",
    "scoreFid": "deWilcoxonDirectionFidelityYieldRaw",
    "scoreReach": "deWilcoxonDirectionReachRaw",
    "scoreJac": "deWilcoxonSigJaccard",
}
ENTRY = "struct<rank:bigint, teamName:string, modelName:string, scoreAvg:double, {}>".format(
    ", ".join(f"{c}:double" for pair in SCORES.items() for c in pair)
)
# A pushed chunk is a string literal: it ends at the first quote after an even run of backslashes.
PUSH = r'(?s)self\.__next_f\.push\(\[1,"(.*?(?<!\\)(?:\\\\)*)"\]\)'


def decode_payload(html: str | Column) -> Column:
    """All pushed chunks of a page, unescaped and joined by line breaks."""
    chunks = F.regexp_extract_all(html, F.lit(PUSH), 1)
    text = lambda c: F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0]
    return F.array_join(F.transform(chunks, lambda c: F.coalesce(text(c), c)), "\n")


def _after(payload: Column, key: str) -> Column:
    """Payload text after the first '"key":', NULL when the key is absent."""
    mark = f'"{key}":'
    at = F.instr(payload, mark)
    return F.when(at > 0, F.substring(payload, at + len(mark), F.length(payload)))


def page_boards(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page, boards array<struct<board, _t, entries>>: the boards of every page, none for a page without.

    A page is decoded once, for all of its boards. The JSON array of a board ends where it closes. A null page has no boards.
    """
    def board(payload: Column, name: str, entries_key: str, total_key: str) -> Column:
        return F.struct(
            F.lit(name).alias("board"),
            F.regexp_extract(F.coalesce(_after(payload, total_key), F.lit("")), r"^(\d+)", 1).alias("_t"),
            F.from_json(_after(payload, entries_key), f"array<{ENTRY}>").alias("entries"),
        )

    every = F.transform(F.array(decode_payload(html)), lambda p: F.array(*[board(p, n, *keys) for n, keys in BOARD_KEYS.items()]))[0]
    return pages.select(id_col, F.filter(every, lambda b: b["entries"].isNotNull()).alias("boards"))


def board_entries(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page, board, total, entries: one row per board found."""
    # the outer form, since Spark would put a filter that decodes the page again below the inner one
    found = page_boards(pages, id_col, html).select(id_col, F.inline_outer("boards")).filter(F.col("entries").isNotNull())
    return found.select(id_col, "board", F.expr("try_cast(_t as bigint)").alias("total"), "entries")


def board_rows(boards: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per entry."""
    return boards.select(id_col, "board", "total", F.inline("entries"))


def pages_without_boards(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """Ids of the pages in which no board is found, without a shuffle."""
    return page_boards(pages, id_col, html).filter(F.size("boards") == 0).select(id_col)


def require_boards(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """The boards, or an error naming a page that has none."""
    boards = board_entries(pages, id_col, html)
    bare = pages_without_boards(pages, id_col, html).limit(1).collect()
    if bare:
        raise ValueError(f"page {bare[0][0]} has no board in its payload")
    return boards
