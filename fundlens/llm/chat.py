"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role become
one block. A block is ``<role:ROLE>`` TEXT, ``<next>`` TEXT for each further turn, and ``<end>``
with a line feed. In roles and texts backslash, ``<`` and ``>`` are written as backslash and b, l
or g, so a control string never occurs in them and the texts can be read back exactly.

``segments`` holds the same output in pieces, each with the mark whether loss is taken on it: the
assistant's texts and nothing else.

Cases: a null text or role is empty. Turns are sorted by (turn, role, text), a null turn first, so
ties have one order; repeated rows are repeated turns. A row without conv_id is a conversation of
its own, so that such rows don't meet in one task. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, segments) from rows (conv_id, turn, role, text)."""
    plain = turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # Sorted as they are and escaped then: escapes have an order of their own.
    collected = plain.groupBy("conv_id", "own").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    collected = collected.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(escape(t.role).alias("role"), escape(t.text).alias("text"), (t.role == loss_role).alias("loss"))).alias("turns"),
    )
    # First positions of the blocks, then each block from its first turn to the next block's.
    firsts = collected.select(
        "conv_id", "turns",
        F.expr("filter(sequence(0, size(turns) - 1), i -> i = 0 OR turns[i].role <> get(turns, i - 1).role)").alias("firsts"),
    )
    blocks = firsts.select(
        "conv_id",
        F.expr(
            "transform(firsts, (a, k) -> struct(turns[a].role AS role, turns[a].loss AS loss, "
            "transform(slice(turns, a + 1, coalesce(get(firsts, k + 1), size(turns)) - a), x -> x.text) AS texts))"
        ).alias("blocks"),
    )
    segments = blocks.select(
        "conv_id",
        F.expr(
            "flatten(transform(blocks, b -> flatten(array("
            "array(struct('<role:' || b.role || '>' AS text, false AS loss)), "
            "flatten(transform(b.texts, (t, k) -> array("
            "struct(CASE WHEN k > 0 THEN '<next>' ELSE '' END AS text, false AS loss), struct(t AS text, b.loss AS loss)))), "
            "array(struct('<end>\\n' AS text, false AS loss))))))"
        ).alias("segments"),
    )
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    blocks = F.filter(F.split(formatted, "<end>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, 7, 2**31 - 1), ">", 1))
        body = F.substring(block, F.locate(">", block) + 1, F.length(block))
        return F.transform(F.split(body, "<next>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output finds: turns from ``formatted``, loss text from ``segments``."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), "segments").select(
        "conv_id", "formatted", "turns",
        F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "").alias("loss_text"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
