"""Preference formatting: a prompt that chosen and rejected conversations share, and two masked completions.

Turns of each side are numbered by their order and matched by that place. The first place at which the sides differ, or at which one
has ended, ends the longest common prefix. Turns before it are the prompt, rendered once; turns from it on are
the chosen and the rejected completion. In a completion the model is to learn what assistant turns say: their
text and end mark have mask 1, headers and other turns mask 0; a prompt has mask 0 throughout.

The result is in long form, a row per place with the completions of both sides side by side (`paired`), or a row per rendered
turn (`format_pairs`): a conversation that is a third of a table is then many rows in many tasks instead of one string in one. Places are
sums over earlier turn numbers, made in ranges of them. `records` puts the turns of a pair together, for tables
whose conversations are known to be short.

Defined results: rows without a pair are left out; a null role reads as the empty one, a null text too; turns are
ordered by number, nulls first, turns of one number by role and text, each repeated row counting as a turn of
its own; turn numbers needn't be the same on both sides; a side without turns gives no completion; equal sides give a prompt alone;
other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import settled
from seqloom.operators.ordinals import CHUNK
from seqloom.operators.running import sums_before

#: Where turns without a number stand.
FIRST = -(1 << 62)
#: The chat template, fixed: header, text, end mark.
HEADER = ("<|im_start|>", "\n")
END = "<|im_end|>\n"
ASSISTANT = "assistant"
CHOSEN, REJECTED, PROMPT = "chosen", "rejected", "prompt"


def header(role: Column) -> Column:
    return F.concat(F.lit(HEADER[0]), role, F.lit(HEADER[1]))


def numbered(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """pair_id, side, turn, role, text and place (the turn's number on its side, from 0)."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin(CHOSEN, REJECTED)).select("pair_id", "side", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    # repeated rows of one turn number, counted before anything is moved
    times = settled(rows.groupBy("pair_id", "side", "turn", "role", "text").agg(F.count("*").alias("times")))
    one = Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text").rowsBetween(Window.unboundedPreceding, -1)
    ranked = times.withColumn("rank", F.coalesce(F.sum("times").over(one), F.lit(0)))
    # how many turns have smaller numbers
    sizes = times.groupBy("pair_id", "side", "turn").agg(F.sum("times").alias("times")).withColumn("at", F.coalesce("turn", F.lit(FIRST)))
    before = sums_before(sizes, ["pair_id", "side"], "at", {"before": "times"}, chunk).select("pair_id", "side", "at", "before")
    out = ranked.withColumn("at", F.coalesce("turn", F.lit(FIRST))).join(before, ["pair_id", "side", "at"])
    start = F.col("before") + F.col("rank")
    return out.select("pair_id", "side", "turn", "role", "text", F.explode(F.sequence(start, start + F.col("times") - 1)).alias("place"))


def places(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """pair_id, place, shared (whether the place is in the prompt) and, for each side, turn, role and text (null where it has ended)."""
    own = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    both = settled(numbered(turns, chunk).groupBy("pair_id", "place").agg(*(own(s, c).alias(f"{s}_{c}") for s in (CHOSEN, REJECTED) for c in ("turn", "role", "text"))))
    alike = F.coalesce((F.col("chosen_role") == F.col("rejected_role")) & (F.col("chosen_text") == F.col("rejected_text")), F.lit(False))
    split = both.groupBy("pair_id").agg(F.min(F.when(~alike, F.col("place"))).alias("split"))
    return both.join(split, "pair_id").withColumn("shared", F.col("split").isNull() | (F.col("place") < F.col("split"))).drop("split")


def mask_of(role: Column) -> Column:
    return (role == ASSISTANT).cast("int")


def body(text: Column) -> Column:
    return F.concat(text, F.lit(END))


def paired(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """turns (pair_id, side, turn, role, text) as a row per place: pair_id, place, prompt (the rendered turn where both sides share it), and chosen and rejected (the completions' turns where they don't), each as header and body with the body's mask."""
    rows = places(turns, chunk)
    side = lambda s: F.when(~F.col("shared") & F.col(f"{s}_role").isNotNull(), True)
    completions = [
        c for s in (CHOSEN, REJECTED)
        for c in (F.when(side(s), header(F.col(f"{s}_role"))).alias(f"{s}_header"), F.when(side(s), body(F.col(f"{s}_text"))).alias(f"{s}_body"), F.when(side(s), mask_of(F.col(f"{s}_role"))).alias(f"{s}_mask"))
    ]
    prompt = F.when(F.col("shared"), F.concat(header(F.col("chosen_role")), body(F.col("chosen_text"))))
    return rows.select("pair_id", "place", prompt.alias(PROMPT), *completions)


def format_pairs(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """turns (pair_id, side, turn, role, text) as rows pair_id, part, place, turn, role, header, body, mask.

    header is rendered with mask 0, body (text and end mark) with `mask`; parts in the order of place.
    """
    item = lambda part, s: F.struct(F.lit(part).alias("part"), F.col(f"{s}_turn").alias("turn"), F.col(f"{s}_role").alias("role"), F.col(f"{s}_text").alias("text"))
    sides = F.when(F.col("shared"), F.array(item(PROMPT, CHOSEN))).otherwise(F.array(item(CHOSEN, CHOSEN), item(REJECTED, REJECTED)))
    out = places(turns, chunk).select("pair_id", "place", F.explode(sides).alias("t")).where(F.col("t.role").isNotNull())
    mask = F.when(F.col("t.part") == PROMPT, 0).otherwise(mask_of(F.col("t.role")))
    return out.select("pair_id", F.col("t.part").alias("part"), "place", F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), header(F.col("t.role")).alias("header"), body(F.col("t.text")).alias("body"), mask.alias("mask"))


def records(formatted: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen and rejected as strings, and for the two the (start, end) of characters with mask 1. For conversations that fit in memory."""
    item = F.struct("place", "header", "body", "mask")

    def part(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == name, item)))

    def text(column: str) -> Column:
        return F.array_join(F.transform(column, lambda t: F.concat(t["header"], t["body"])), "")

    def spans(column: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(t["header"])
            end = begin + F.length(t["body"])
            more = F.when(t["mask"] == 1, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], more).alias("spans"))

        return F.aggregate(column, start, step, lambda acc: acc["spans"])

    rows = formatted.groupBy("pair_id").agg(*(part(p).alias(f"_{p}") for p in (PROMPT, CHOSEN, REJECTED)))
    return rows.select("pair_id", *(text(f"_{p}").alias(p) for p in (PROMPT, CHOSEN, REJECTED)), *(spans(f"_{p}").alias(f"{p}_learnt") for p in (CHOSEN, REJECTED)))


def swapped_endings(conversations: DataFrame) -> DataFrame:
    """Preference pairs of a plain table of conversations: each with its own last turn (chosen) and with that of the next id (rejected).

    A conversation whose next id is missing has no rejected ending; its pair's rejected side stops one turn earlier.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")
    last = rows.groupBy("pair_id").agg(F.max(place).alias("last"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.role").alias("role"), F.col("last.text").alias("text"))
    chosen = rows.select("pair_id", F.lit(CHOSEN).alias("side"), "turn", "role", "text")
    same = rows.join(last, "pair_id").where(~place.eqNullSafe(F.col("last"))).select("pair_id", F.lit(REJECTED).alias("side"), "turn", "role", "text")
    ending = last.select("pair_id", F.lit(REJECTED).alias("side"), F.col("last.turn").alias("turn")).join(other, "pair_id")
    return chosen.unionByName(same).unionByName(ending)
