"""Chat formatting over typed content parts, native.

A turn holds an array of parts (kind, text, ref, width, height, seconds, pages). The visitor turns each part
into one piece of the output: text is escaped, an image, audio or document becomes a placeholder in its
place, its reference is recorded as an attachment together with the number of tokens the placeholder stands
for. A conversation becomes ``<s>`` and for each turn ``<|turn|>role<|content|>pieces<|end|>``.

Escaping puts one ``U+241B`` behind the first character of every control string in a text or role, and one
more where some already stand there; reading back takes one away. So texts hold no control string that works,
and every text comes back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pertmatrix.llm.common import let

#: Control strings that must not stand in a text unescaped, without their first character.
CONTROL_TAILS = (r"s>", r"/s>", r"\|", r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>")
START, TURN, CONTENT, END = "<s>", "<|turn|>", "<|content|>", "<|end|>"
MARK = "␛"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens behind one placeholder: an image by patches of so many pixels a side, audio by second, documents by page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 256

_TAILS = "|".join(CONTROL_TAILS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({MARK}*)(?={_TAILS})", f"$1{MARK}$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){MARK}({MARK}*)(?={_TAILS})", "$1$2")


def text_part(text: Column) -> Column:
    """A turn's parts where it is one text; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")]).cast(PART))


def _content(parts: Column) -> Column:
    """The visitor: neighbouring texts are joined before they are escaped, so no control string arises at their seam."""
    placeholder = F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.items() for x in kv])
    begun = F.struct(F.lit("").alias("done"), F.lit("").alias("pending"))

    def visit(seen: Column, part: Column) -> Column:
        mark = F.try_element_at(placeholder, F.coalesce(part["kind"], F.lit("text")))
        text = F.struct(seen["done"].alias("done"), F.concat(seen["pending"], F.coalesce(part["text"], F.lit(""))).alias("pending"))
        return F.when(mark.isNull(), text).otherwise(F.struct(F.concat(seen["done"], escape(seen["pending"]), mark).alias("done"), F.lit("").alias("pending")))

    return F.aggregate(parts, begun, visit, lambda seen: F.concat(seen["done"], escape(seen["pending"])))


def _expanded(part: Column) -> Column:
    image = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    audio = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND)
    pages = F.coalesce(part["pages"], F.lit(0)) * F.lit(PER_PAGE)
    sizes = F.when(part["kind"] == "image", image).when(part["kind"] == "audio", audio).when(part["kind"] == "document", pages)
    return F.coalesce(sizes.cast("bigint"), F.lit(0).cast("bigint"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``loss_spans`` holds (turn, start, stop): code points of the formatted turn, counted from its first
    character, that are trained on: the content of each turn of ``trained_role``. ``attachments`` holds
    (turn, part, kind, ref, tokens) in the order of the placeholders. Turns go by ``turn``, nulls first, then
    role, then content before it is escaped, so ties and repeated rows have one result up to equal rows; all rows stay. A null
    role is the empty role, a null or empty array of parts an empty content, a part of another kind than image,
    audio or document is text. Rows with a null conversation are one conversation with a null id. Columns not
    named in the arguments are ignored. A conversation is one output value, so its turns meet in one task;
    escaping and counting come before that.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    kinds = list(PLACEHOLDERS)
    visited = turns.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit("")).alias("_role"),
        _content(parts).alias("_content"),
        F.filter(
            F.transform(parts, lambda p, k: F.struct(k.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))),
            lambda a: F.coalesce(a["kind"].isin(kinds), F.lit(False)),
        ).alias("_attached"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(CONTENT))
    # the order needs the content as it was before it was escaped, which is made behind the exchange
    keyed = visited.repartition("_conv").withColumn("_raw", unescape(F.col("_content")))
    placed = keyed.withColumn("_at", F.row_number().over(Window.partitionBy("_conv").orderBy("_turn", "_role", "_raw", "_content", F.xxhash64("_attached"))) - 1)
    turn = F.struct(
        F.col("_at").alias("at"),
        F.concat(head, "_content", F.lit(END)).alias("piece"),
        F.when(F.col("_role") == trained_role, F.struct(F.col("_at").alias("turn"), F.length(head).alias("start"), (F.length(head) + F.length("_content")).alias("stop"))).alias("span"),
        F.transform("_attached", lambda a: F.struct(F.col("_at").alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attached"),
    )
    gathered = placed.select("_conv", turn.alias("_t")).groupBy("_conv").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    attached = F.flatten(F.transform("_ts", lambda t: t["attached"]))
    return gathered.select(
        F.col("_conv").alias(conv_col),
        F.size("_ts").cast("bigint").alias("n_turns"),
        F.concat(F.lit(START), F.concat_ws("", F.transform("_ts", lambda t: t["piece"]))).alias("formatted"),
        F.filter(F.transform("_ts", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def split_turns(formatted: Column) -> Column:
    """The formatted turns, from ``<|turn|>`` up to, without, ``<|end|>``."""
    body = F.substring(formatted, len(START) + 1, F.length(formatted))
    return F.filter(F.split(body, END.replace("|", r"\|")), lambda t: t != "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay as they stand."""
    return F.transform(
        split_turns(formatted),
        lambda t: F.struct(
            unescape(F.substring_index(F.substring(t, len(TURN) + 1, F.length(t)), CONTENT, 1)).alias("role"),
            unescape(F.substring(t, F.instr(t, CONTENT) + len(CONTENT), F.length(t))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """array<string>: the unescaped text of each loss span, in order."""
    return let(split_turns(formatted), lambda ts: F.transform(loss_spans, lambda s: unescape(F.substring(F.get(ts, s["turn"]), s["start"] + 1, s["stop"] - s["start"]))))
