"""Chat formatting by multi-party perspective rotation.

Every conversation is rendered once for each of its participants: that speaker's turns
are the assistant's, everybody else's are a named user's, and only the assistant's
words (with their end marker) are in the loss mask.  Roles in `context_roles` are no
participants; their turns open as that role in every rendering.

All of it is DataFrame expressions.  Participants are found by a pre-aggregated
distinct; turns join them on the conversation, so a hot conversation is a skewed join
that Spark may split.  A rendering comes in blocks of `block_turns` turn numbers, so
that a very long dialogue is some rows, never one unbounded one; within a block rows
are ordered by (turn, role, text).

Defined results
* null role: the speaker `unknown`.  Null text: an empty message.  Null turn: before
  all others, in block 0.  Null conv_id: a conversation of its own.
* ties (rows with equal turn): ordered by role, then text; repeated rows are repeated
  messages.
* a conversation of context roles only has no participant and gives no row.
* markers inside a text or a name are broken up ("<|" becomes "< |"), so no message can
  pose as another; mask positions count the characters of the result.
* empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
BLOCK_TURNS = 1024


def _clean(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def segments(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row for each participant and turn of a conversation: speaker, block, turn, role, head, body, masked."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.greatest(F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block_turns), F.lit(0)).cast("long").alias("block"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    context = F.col("role").isin(*context_roles) if context_roles else F.lit(False)
    speakers = rows.where(~context).groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("own_turns")).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker"))
    both = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    head = (
        F.when(context, F.concat(F.lit("<|"), _clean(F.col("role")), F.lit("|>\n")))
        .when(F.col("role") == F.col("speaker"), F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _clean(F.col("role")), F.lit("|>\n")))
    )
    return both.select("conv_id", "speaker", "block", "turn", "role", "text", head.alias("head"), F.concat(_clean(F.col("text")), F.lit(END)).alias("body"), (~context & (F.col("role") == F.col("speaker"))).alias("masked"))


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Per conversation, participant and block: n_turns, rendered text, loss mask as an array of (start, end) character spans."""
    seg = segments(turns, context_roles, block_turns)
    item = F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))).alias("o"), "role", "text", "head", "body", "masked")
    grouped = seg.groupBy("conv_id", "speaker", "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["masked"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return grouped.select(
        "conv_id",
        "speaker",
        "block",
        F.size("items").cast("long").alias("n_turns"),
        F.array_join(F.transform("items", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.aggregate("items", start, step)["spans"].alias("mask"),
    )
