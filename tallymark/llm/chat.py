"""Preference formatting of chat turns.

A pair has a chosen and a rejected conversation. Their longest common turn prefix is rendered once, as the prompt; what
follows on either side is a completion, rendered with the spans of its characters that count for the loss (what assistants
say, up to and with the end of their turn). A part is one row, whose text is its turns one after the other. Only a part that
goes over several blocks of BLOCK turn numbers, or has a turn number with more than BLOCK rows, has a row for each block and
each BLOCK rows (chunk, over: their order), so a conversation of any length is never gathered in one place.

Turns of both sides are compared at equal turn numbers, by role and text; rows that share a number are ordered by role and
text, repeated rows count each, a null number comes first. A null text is empty, a null role is `unknown`. Turns without a
conversation are dropped. If one side ends where the other goes on, the rest is a completion; equal conversations are all
prompt. An empty table gives no rows; other columns, whatever their names, don't matter. The rows move once, by pair and
block; what is known of a whole pair is joined to its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import pick

HEAD, TAIL = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
BLOCK = 32


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, block, turn, role, text."""
    own = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where(F.col("conv_id").isNotNull())
    own = own.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select("conv_id", F.floor(F.col("turn") / BLOCK).alias("block"), "turn", "role", "text")


def answer_swaps(conversations: DataFrame) -> DataFrame:
    """Pairs from plain conversations: pair_id, block, turn, nth, chosen, rejected (structs of role and text). Chosen: a
    conversation up to its last turn of the assistant. Rejected: the same, with the last such turn of its neighbour (ids 2k and
    2k + 1) in that turn's place, an empty one if there is no neighbour. A conversation without such a turn stands on both
    sides."""
    own = turns(conversations)
    last = own.where(F.col("role") == ASSISTANT).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = last.select("conv_id", F.col("last.turn").alias("end"), F.col("last.text").alias("answer"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("answer").alias("other"))
    ends = last.join(other, "conv_id", "left")
    blocks = own.select("conv_id", "block").distinct().join(ends, "conv_id")
    here = F.floor(F.col("end") / BLOCK) == F.col("block")
    blocks = blocks.select("conv_id", "block", "end", F.when(here, F.col("answer")).alias("answer"), F.when(here, F.coalesce("other", F.lit(""))).alias("other"))
    order = Window.partitionBy("conv_id", "block", "turn").orderBy("role", "text")
    dealt = own.repartition("conv_id", "block").withColumns({"nth": F.row_number().over(order), "next": F.lead(F.struct("role", "text")).over(order)})
    known = dealt.join(blocks, ["conv_id", "block"], "left")
    said = (F.col("turn") == F.col("end")) & (F.col("role") == ASSISTANT)
    upto = F.col("end").isNull() | (F.col("turn") < F.col("end")) | ((F.col("turn") == F.col("end")) & (F.col("role") <= ASSISTANT))
    at_end = said & (F.col("text") == F.col("answer")) & ~F.col("next").eqNullSafe(F.struct("role", "text"))
    rejected = F.struct("role", F.when(F.coalesce(at_end, F.lit(False)), F.col("other")).otherwise(F.col("text")).alias("text"))
    return known.where(upto).select(F.col("conv_id").alias("pair_id"), "block", "turn", "nth", F.struct("role", "text").alias("chosen"), rejected.alias("rejected"))


def sides(pairs: DataFrame) -> DataFrame:
    """Pairs given by rows of either side (pair_id, side: chosen or rejected, turn, role, text) as answer_swaps() has them."""
    own = pairs.select("pair_id", F.floor(F.col("turn") / BLOCK).alias("block"), F.col("turn").cast("long").alias("turn"), "side", "role", "text")
    nth = F.row_number().over(Window.partitionBy("pair_id", "block", "turn", "side").orderBy("role", "text"))
    both = own.repartition("pair_id", "block").withColumn("nth", nth).groupBy("pair_id", "block", "turn", "nth")
    return both.agg(*[F.max(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s) for s in ("chosen", "rejected")])


def opening(role: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit("\n"))


def format_preferences(two: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), chunk, over, n_turns, text and loss (spans start-end of the text's characters,
    with commas between) of pairs (pair_id, block, turn, nth, chosen, rejected)."""
    at = F.struct("turn", "nth")
    split = two.where(~F.col("chosen").eqNullSafe(F.col("rejected"))).groupBy("pair_id").agg(F.min(at).alias("split"))
    blocks = two.select("pair_id", "block").distinct().join(split, "pair_id")
    row = lambda part, side: F.struct(F.lit(part).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))
    common = F.col("split").isNull() | (at < F.col("split"))
    parts = F.when(common, F.array(row("prompt", "chosen"))).otherwise(F.filter(F.array(row("chosen", "chosen"), row("rejected", "rejected")), lambda x: x["role"].isNotNull()))
    flat = two.join(blocks, ["pair_id", "block"], "left").select("pair_id", "block", F.floor((F.col("nth") - 1) / BLOCK).alias("over"), "turn", "nth", F.explode(parts).alias("r"))
    # BLOCK * BLOCK turns at most
    got = flat.groupBy("pair_id", "block", "over", "r.part").agg(F.array_sort(F.collect_list(F.struct("turn", "nth", F.col("r.role").alias("role"), F.col("r.text").alias("text")))).alias("said"))
    text = F.concat_ws("", F.transform("said", lambda x: F.concat(opening(x["role"]), x["text"], F.lit(TAIL))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(so_far: Column, x: Column) -> Column:
        head, end = F.length(opening(x["role"])), F.length(opening(x["role"])) + F.length(x["text"]) + len(TAIL)
        span = F.concat_ws("-", (so_far["at"] + head).cast("string"), (so_far["at"] + end).cast("string"))
        return F.struct((so_far["at"] + end).alias("at"), F.when(x["role"] == ASSISTANT, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans"))

    loss = F.when(F.col("part") != "prompt", F.array_join(F.aggregate("said", start, add)["spans"], ",")).otherwise("")
    return got.select("pair_id", "part", F.col("block").alias("chunk"), "over", F.size("said").cast("long").alias("n_turns"), text.alias("text"), loss.alias("loss"))
