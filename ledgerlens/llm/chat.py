"""Chat formatting by perspective rotation (DataFrame functions only).

Method: for every participant of a dialogue the whole dialogue is rendered once,
with that speaker as the assistant, all others as named users and system turns
as they are; a mask says which characters are trained on: the speaker's own
words and the end mark after them.

    <|im_start|>system\\n...<|im_end|>\\n
    <|im_start|>user name=ann\\n...<|im_end|>\\n
    <|im_start|>assistant\\n...<|im_end|>\\n

Participants are the distinct roles of a conversation other than ``system``.
Turns are ordered by number (null first), role, text; rows that repeat all of
these are one turn. A dialogue is rendered in parts of ``part_turns`` turns in
this order. A part that does not begin the dialogue opens with the dialogue's
first system turn, if that came before (it does not count as a turn of the
part); mask offsets are those of the part's text, ``first_turn`` says where in the
dialogue the part begins.

A conversation may hold a third of all rows, with numbers that are null or
equal: turns are sorted over range partitions, each numbers its own, and one row
per conversation and partition (its number of turns) makes the places global.
So no task gets more than its share, and no group more than ``part_turns`` turns.

Defined results: null or empty role: ``unknown``; null text: empty; rows with a
null conversation id are one conversation. A dialogue of system turns alone has
no participant and no row. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import written

# fixed values: marks of the rendered format
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
SYSTEM, UNKNOWN = "system", "unknown"
PART_TURNS = 256


def _head(role: Column, speaker: Column) -> Column:
    name = F.when(role == speaker, "assistant").when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), name, F.lit(BREAK))


def _mask(turns: Column, speaker: Column, begin_at: Column) -> Column:
    """(start, end) of the trained characters, counted in code points; the first turn is at ``begin_at``."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(_head(t["role"], speaker))
        end = begin + F.length(t["text"]) + len(END)
        own = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        spans = F.when(t["role"] == speaker, F.concat(state["spans"], own)).otherwise(state["spans"])
        return F.struct((end + len(BREAK)).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(begin_at.cast("int").alias("at"), none.alias("spans")), add, lambda s: s["spans"])


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place (number of the turn in its conversation, from 0). ``turns``: different rows."""
    order = ["turn", "role", F.substring("text", 1, 64)]  # a range is cut between different keys
    dealt = written(turns.repartitionByRange("conv_id", *order).withColumn("p", F.spark_partition_id()))
    sizes = dealt.groupBy("conv_id", "p").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = written(sizes.select(F.col("conv_id").alias("of"), F.col("p").alias("q"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    own = F.row_number().over(Window.partitionBy("conv_id", "p").orderBy("turn", "role", "text"))
    numbered = dealt.withColumn("own", own)
    joined = numbered.join(before, (F.col("p") == F.col("q")) & F.col("conv_id").eqNullSafe(F.col("of")))
    return joined.select("conv_id", "role", "text", (F.col("before") + F.col("own") - 1).alias("place"))


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, first_turn, n_turns, text, mask for every participant and part of every dialogue."""
    role = F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit(UNKNOWN)).alias("role")
    turns = conversations.select("conv_id", "turn", role, F.coalesce("text", F.lit("")).alias("text")).distinct()
    placed = written(placed_turns(turns))
    part = F.floor(F.col("place") / part_turns).alias("part")
    parts = placed.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    opening = placed.where(F.col("role") == SYSTEM).groupBy("conv_id").agg(F.min(F.struct("place", "text")).alias("opening"))
    opening = written(opening.select(F.col("conv_id").alias("led"), "opening"))
    speakers = written(placed.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct())
    parts = written(parts)
    led = parts.join(opening, parts.conv_id.eqNullSafe(opening.led), "left")
    joined = led.join(speakers, led.conv_id.eqNullSafe(speakers.of))
    first = F.col("part") * part_turns
    carried = F.concat(_head(F.lit(SYSTEM), F.lit("")), F.col("opening.text"), F.lit(END + BREAK))
    lead = F.when(F.col("opening.place") < first, carried).otherwise(F.lit(""))
    speaker = F.col("perspective")
    rendered = F.transform("turns", lambda t: F.concat(_head(t["role"], speaker), t["text"], F.lit(END + BREAK)))
    return joined.withColumn("lead", lead).select(
        "conv_id",
        "perspective",
        "part",
        first.alias("first_turn"),
        F.size("turns").cast("long").alias("n_turns"),
        F.concat("lead", F.array_join(rendered, "")).alias("text"),
        _mask(F.col("turns"), speaker, F.length("lead")).alias("mask"),
    )
