"""Positions in a whole table without sorting it in one task.

A global ROW_NUMBER moves all rows to one partition. Here rows are dealt to ranges of the sort order, as many as there are
shuffle partitions, and written once; ties of the first column are dealt by the next ones. A row's position is its place in its range
and the number of rows in the ranges before, of which there is one for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.storage import kept

#: monotonically_increasing_id() has a row's place in its partition below this bit.
PLACE_BITS = 33
#: Positions that are looked at in one task, and rows of a sequence that are numbered in one.
CHUNK = 1_000_000


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in the order given, written once, with _part (its range) and _place (in the range)."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    parts = {"_part": F.shiftright("_id", PLACE_BITS), "_place": F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)}
    return kept(dealt).withColumns(parts).drop("_id")


def ordinals(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's position from 0 in a column `name`."""
    ranges = in_ranges(df, order)
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = F.broadcast(counts.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset")))
    return ranges.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def nth_position(positions: DataFrame, column: str, n: int, size: int, pieces: int = 1024) -> int | None:
    """The n-th smallest (from 0) of different integers from 0 to size - 1, null where there are fewer: counts of `pieces` ranges, then of ranges of the one it is in."""
    low, width = 0, max(1, size)
    while True:
        step = -(-width // pieces)
        inside = positions.where((F.col(column) >= low) & (F.col(column) < low + width))
        counts = inside.groupBy(F.floor((F.col(column) - low) / F.lit(step)).alias("at")).agg(F.count("*").alias("c")).collect()  # `pieces` at most
        found = None
        for at, c in sorted((r["at"], r["c"]) for r in counts):
            if n < c:
                found = at
                break
            n -= c
        if found is None:
            return None
        low, width = low + found * step, step
        if step == 1:
            return low


def positions_within(members: DataFrame, group: str, order: str, span: int, chunk: int = CHUNK) -> DataFrame:
    """members with pos: each row's place in its group by the whole number `order`, whose values lie within `span`. A group's rows are numbered in ranges of `chunk` numbers, each for itself."""
    if span <= chunk:
        return members.withColumn("pos", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))
    rows = members.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))
    own = Window.partitionBy(group, "_chunk").orderBy(order)
    earlier = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range that a group has rows in
    offsets = rows.groupBy(group, "_chunk").agg(F.count("*").alias("_rows")).withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    return rows.withColumn("_place", F.row_number().over(own) - 1).join(offsets, [group, "_chunk"]).withColumn("pos", F.col("_offset") + F.col("_place")).drop("_chunk", "_place", "_offset")
