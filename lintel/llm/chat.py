"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted by (turn, role, text), adjacent turns of one role
become one block, and the blocks are concatenated:

    <|start|>ROLE<|text|>TURN<|next|>TURN<|end|>...

Control strings inside texts and roles are escaped: "<", backslashes and "|" get one more backslash
before the "|", which unescape takes away again, so no text can close its block.

loss_runs is the loss mask as runs of code points (len, on): on for the texts of the trained role, off
for everything else, in the order of the formatted text, summing to its length.

Null texts and roles count as empty; a null conversation id is a conversation; repeated rows are turns
of their own; ties of turn are ordered by role, then text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: the id, formatted string and loss_runs array<struct<len long, on boolean>>."""
    at = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(at)).alias("turns"))
    # where a role differs from the one before: the first turns of blocks
    firsts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"] != F.element_at("turns", i)["role"]),
    )
    ends = F.concat(F.slice("firsts", F.lit(2), F.size("firsts")), F.array(F.size("turns") + 1))
    blocks = F.transform(
        F.arrays_zip("firsts", "ends"),
        lambda b: F.struct(
            F.element_at("turns", b["firsts"])["role"].alias("role"),
            F.transform(F.slice("turns", b["firsts"], b["ends"] - b["firsts"]), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    header = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(TEXT))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(header(b), F.array_join(b["texts"], NEXT), F.lit(END))), "")
    length = lambda c: F.char_length(c).cast("long")
    run = lambda n, on: F.struct(n.alias("len"), on.alias("on"))
    # runs alternate: what stands before a text (the end of a block and a header, or the mark between turns), then the text
    before = lambda b, j, i: F.when(i > 0, F.lit(len(NEXT))).otherwise(F.when(j > 0, F.lit(len(END))).otherwise(F.lit(0)) + F.char_length(header(b)))
    runs = F.flatten(
        F.transform(
            "blocks",
            lambda b, j: F.flatten(F.transform(b["texts"], lambda t, i: F.array(run(before(b, j, i).cast("long"), F.lit(False)), run(length(t), b["role"] == trained)))),
        )
    )
    last = F.array(run(F.lit(len(END)).cast("long"), F.lit(False)))
    return (
        sorted_turns.withColumn("firsts", firsts)
        .withColumn("ends", ends)
        .withColumn("blocks", blocks)
        .select(conv, formatted.alias("formatted"), F.concat(runs, last).alias("loss_runs"))
    )


def read_chats(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read format_chats' output back: turns array<struct<role, text>> and masked, the escaped texts under the loss mask.

    The mask's runs must fit the formatted text; a run under the mask that isn't one whole text raises."""
    parts = F.transform(
        F.slice(F.split("formatted", r"<\|start\|>"), F.lit(2), F.size(F.split("formatted", r"<\|start\|>"))),
        lambda b: F.split(b, r"<\|(?:text|next|end)\|>"),
    )
    turns = F.flatten(F.transform("parts", lambda p: F.transform(F.slice(p, F.lit(2), F.size(p) - 2), lambda t: F.struct(p[0].alias("role"), t.alias("text")))))
    text_runs = F.filter("loss_runs", lambda r, i: i % 2 == 1)
    zipped = F.arrays_zip("raw", "text_runs")
    masked = F.transform(F.filter(zipped, lambda z: z["text_runs"]["on"]), lambda z: z["raw"]["text"])
    fits = F.forall(zipped, lambda z: z["raw"].isNotNull() & (z["text_runs"]["len"] == F.char_length(z["raw"]["text"])))
    return (
        chats.withColumn("parts", parts)
        .withColumn("raw", turns)
        .withColumn("text_runs", text_runs)
        .select(
            conv,
            "formatted",
            F.transform("raw", lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))).alias("turns"),
            F.when(fits, masked).otherwise(F.raise_error(F.lit("the loss mask does not fit the formatted text"))).alias("masked"),
        )
    )
