"""Conversations logged again after each turn, collapsed to the longest and rendered.

A log that writes a conversation each time it grows holds many beginnings of
the same conversation. A running sum of position-bound turn hashes gives each
beginning a digest. A conversation whose digest is that of a proper beginning of
another is a snapshot of it and goes; of equal conversations one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywarden.llm.common import kept
from tallywarden.plans.ordered import ordering, running_sums
from tallywarden.plans.skew import ROWS_PER_TASK, match

# Marks of the chat format.
START, END = "<|im_start|>", "<|im_end|>"
# Turns rendered into one row; a longer conversation takes several rows.
TURNS_PER_SEGMENT = 64

DIGEST = ["_d1", "_d2"]


def turn_prefixes(turns: DataFrame, limit: int = ROWS_PER_TASK) -> DataFrame:
    """Number the turns of each conversation from 1 and add the digest of all turns up to each.

    Turns go by ``turn``, nulls first, ties by role and text. Null roles and texts are read as empty. Rows
    without a ``conv_id`` are one conversation. An empty log has no turns.
    """
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    said = said.withColumn("_said", F.md5(F.concat(F.length("role"), F.lit("|"), "role", "text")))
    by = ordering(said, ["conv_id"], ["turn", "role", "text"], limit)
    numbered = running_sums(said, by, {"_n": F.lit(1)})
    at = F.md5(F.concat_ws("|", F.col("_n").cast("string"), "_said"))

    def part(start: int) -> Column:
        return F.conv(F.substring(at, start, 15), 16, 10).cast("decimal(20,0)")

    # Two 60-bit parts of a 128-bit hash, added up in decimals that can't overflow.
    return running_sums(numbered, by, {"_d1": part(1), "_d2": part(16)}).drop("_said")


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """One row per conversation that is no beginning of a longer one; ``copies`` counts its equals.

    Of equal conversations the smallest ``conv_id`` stays, null before all others.
    """
    # Positions and digests only grow, so the largest are those of the whole conversation.
    ends = prefixes.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("_n", *DIGEST)))
    beginnings = match(prefixes.select("conv_id", "_n", *DIGEST), ends, ["conv_id", "_n"], "left_anti")
    first = F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id"))["conv_id"]
    distinct = ends.groupBy("_n", *DIGEST).agg(first.alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    longer = beginnings.select("_n", *DIGEST).distinct()
    return distinct.join(longer, ["_n", *DIGEST], "left_anti").select("conv_id", F.col("_n").alias("turns"), "copies")


def rendered_turn(role: str, text: str) -> Column:
    """One turn in the chat format; marks inside a text are broken up."""
    plain = [F.replace(F.col(c), F.lit("<|"), F.lit("< |")) for c in (role, text)]
    return F.concat(F.lit(START), plain[0], F.lit("\n"), plain[1], F.lit(END + "\n"))


def format_conversations(
    turns: DataFrame, turns_per_segment: int = TURNS_PER_SEGMENT, limit: int = ROWS_PER_TASK
) -> DataFrame:
    """Render the maximal conversations of a log.

    Returns conv_id, segment (from 0), segments, turns of the whole conversation, copies (equal
    conversations in the log) and text. Conversations of more than ``turns_per_segment`` turns take
    several rows, so that no row or group grows with a conversation. Other columns of the log are ignored.
    """
    prefixes = kept(turn_prefixes(turns, limit), "turns")
    chosen = maximal_conversations(prefixes)
    lines = match(prefixes.select("conv_id", "_n", rendered_turn("role", "text").alias("_line")), chosen, ["conv_id"])
    segment = F.floor((F.col("_n") - 1) / turns_per_segment).cast("int")
    in_order = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    return (
        lines.groupBy("conv_id", segment.alias("segment"))
        .agg(
            F.max("turns").cast("long").alias("turns"),
            F.max("copies").alias("copies"),
            F.array_join(F.transform(in_order, lambda x: x["_line"]), "").alias("text"),
        )
        .select(
            "conv_id",
            "segment",
            F.ceil(F.col("turns") / turns_per_segment).cast("int").alias("segments"),
            "turns",
            "copies",
            "text",
        )
    )
