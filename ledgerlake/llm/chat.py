"""Chat formatting with relational expressions only.

Turn structs are collected per conversation and sorted, adjacent turns of one role are merged by
an array aggregation, and the blocks are concatenated. A block is
``<|im_start|>role\\n`` + texts joined by ``<|im_sep|>`` + ``<|im_end|>\\n``.

Inside texts and roles every ``<`` + backslashes + ``|`` gets one more backslash, so no control
string survives; removing one backslash restores the text. Roles also write line feeds as
``\\n`` and backslashes doubled, since a line feed ends the role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # the private-use character stands in for a doubled backslash while line feeds are restored
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """One row per conversation: conv id, ``formatted``, ``loss_spans`` (code-point ranges of
    ``formatted`` that hold assistant texts).

    Turns sort by (turn, role, text), null turns first; equal rows stay as turns of their own.
    Null texts and roles count as empty. A null conversation id is a conversation. Other
    columns are ignored; an empty table gives no rows. A conversation is one output value, so
    its turns must fit in a row.
    """
    turns = df.select(F.col(conv_col).alias("_c"), F.struct(
        F.col(turn_col).alias("turn"), escape_role(F.coalesce(F.col(role_col), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).alias("_turn"))
    sorted_turns = turns.groupBy("_c").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    before = lambda i: F.get("_turns", i - 1)["role"]  # noqa: E731  null for the first turn
    blocks = sorted_turns.select("_c", "_turns", F.transform("_turns", lambda t, i: (
        F.when(i == 0, F.concat(F.lit(START), t["role"], F.lit("\n")))
        .when(t["role"] == before(i), F.lit(SEP))
        .otherwise(F.concat(F.lit(END + START), t["role"], F.lit("\n"))))).alias("_open"))
    # Where a text ends: running lengths, each block of RUN turns added up by itself, then the blocks.
    sizes = F.zip_with("_open", "_turns", lambda o, t: (F.length(o) + F.length(t["text"])).cast("long"))
    ended = blocks.withColumn("_sizes", sizes).withColumn("_end", _running("_sizes"))
    spans = F.filter(F.zip_with("_end", "_turns", lambda e, t: F.when(t["role"] == "assistant", F.struct(
        (e - F.length(t["text"])).alias("start"), e.alias("end")))), lambda s: s.isNotNull())
    return ended.select(F.col("_c").alias(conv_col),
                        F.concat(F.array_join(F.zip_with("_open", "_turns", lambda o, t: F.concat(o, t["text"])), ""), F.lit(END)).alias("formatted"),
                        spans.alias("loss_spans"))


#: Turns whose lengths are added up together.
RUN = 64


def _running(sizes: str) -> Column:
    """Running sums of an array of longs. Sums within runs of ``RUN`` and over the runs copy little, however long the array."""
    def sums(values, start):
        return F.aggregate(values, F.array(start), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    runs = F.sequence(F.lit(0), F.ceil(F.size(sizes) / RUN).cast("int") - 1)
    totals = F.transform(runs, lambda r: F.aggregate(F.slice(sizes, r * RUN + 1, F.lit(RUN)), F.lit(0).cast("long"), lambda a, v: a + v))
    # the sums before each run; runs are few, as many as the RUNth part of the turns
    starts = F.transform(F.array(totals), lambda t: F.transform(runs, lambda r: F.aggregate(
        F.slice(t, F.lit(1), r), F.lit(0).cast("long"), lambda a, v: a + v)))[0]
    inner = F.transform(F.array(starts), lambda s: F.transform(runs, lambda r: F.slice(
        sums(F.slice(sizes, r * RUN + 1, F.lit(RUN)), F.element_at(s, r + 1)), F.lit(2), F.lit(RUN))))[0]
    return F.flatten(inner)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped."""
    parts = F.split(formatted, r"<\|im_start\|>")  # the first is the empty text before the first block
    blocks = F.slice(parts, F.lit(2), F.size(parts))

    def turns(block):
        role = unescape_role(F.substring_index(block, "\n", 1))
        body = F.substr(block, F.length(F.substring_index(block, "\n", 1)) + 2)
        body = F.substr(body, F.lit(1), F.length(body) - F.lit(len(END)))
        return F.transform(F.split(body, r"<\|im_sep\|>"),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
