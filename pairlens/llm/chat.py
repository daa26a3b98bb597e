"""Perspective rotation of multi-party dialogues.

For every participant (every role but system) the dialogue is rendered with that speaker as the assistant and
all others as users with their names; masks mark the characters that are trained on: the speaker's own texts with their
end marks. A dialogue is rendered in segments of at most SEGMENT turns, so that no dialogue, however long, is
one row; every turn is in one segment.

Defined results: turns are in the order of turn (null first), then role and text; equal rows of a dialogue are one turn;
a null text is empty, a null role is the participant "unknown"; a dialogue of system turns only gives no rows; rows with null
conv_id are one dialogue; texts keep "<|" apart by a zero-width space, so that they hold no marks. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(column: F.Column) -> F.Column:
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("<​|"))


def perspectives(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, participant, block, part, n_turns, n_masked, masks, text); masks are start:end of text, comma-joined."""
    role = F.regexp_replace(_safe(F.coalesce("role", F.lit("unknown"))), r"[\r\n]+", " ")
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), _safe(F.col("text")).alias("text")).distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / segment).cast("long"))
    # turns that share a number may make a block long; numbering streams over the sorted rows
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = turns.withColumn("part", F.floor((F.row_number().over(order) - 1) / segment).cast("long"))
    segments = turns.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    people = turns.where("role <> 'system'").select(F.col("conv_id").alias("pairlens_conv"), F.col("role").alias("participant")).distinct()
    rows = segments.join(people, F.col("conv_id").eqNullSafe(F.col("pairlens_conv"))).drop("pairlens_conv")

    def head(t):
        speaker = F.when(t["role"] == F.col("participant"), "assistant").when(t["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(START), speaker, F.lit("\n"))

    messages = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("participant")).alias("own")))
    rows = rows.withColumn("messages", messages)
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s: bigint, e: bigint>>").alias("spans"))

    def step(acc, m):
        begin = acc["at"] + F.length(m["head"])
        end = begin + F.length(m["body"])
        span = F.array(F.struct(begin.cast("long").alias("s"), end.cast("long").alias("e")))
        return F.struct(end.cast("long").alias("at"), F.when(m["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    rows = rows.withColumn("spans", F.aggregate("messages", empty, step, lambda acc: acc["spans"]))
    return rows.select(
        "conv_id",
        "participant",
        "block",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["e"] - s["s"]).alias("n_masked"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["s"].cast("string"), s["e"].cast("string"))), ",").alias("masks"),
        F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["body"])), "").alias("text"),
    )
