"""Sums over all earlier rows, and values of the rows just before, without one task per key.

A window over a key's rows is one task for each key. Here a key's rows are dealt to ranges of their position, (key, position // chunk):
sums are made in each range and the totals of the ranges before are added (one row for each range that a key has rows in);
values of the k rows before a range are taken from its neighbours, which send their last k rows along (a halo).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.ordinals import CHUNK

RANGE = "_range"


def sums_before(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], chunk: int = CHUNK, ties: bool = False) -> DataFrame:
    """df with, for each name in values, the sum of that column over the rows of its key at smaller positions `order` (whole numbers, not negative).

    ties: whether several rows of a key may have one position; none of them counts for another.
    """
    rows = df.withColumn(RANGE, F.floor(F.col(order) / F.lit(chunk)))
    frame = Window.partitionBy(*keys, RANGE).orderBy(order)
    frame = frame.rangeBetween(Window.unboundedPreceding, -1) if ties else frame.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, RANGE).agg(*(F.sum(column).alias(f"_{name}") for name, column in values.items()))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, RANGE, *(F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in values))
    inside = rows.withColumns({name: F.coalesce(F.sum(column).over(frame), F.lit(0)) for name, column in values.items()})
    out = inside.join(carried, [*keys, RANGE])
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in values}).drop(RANGE, *(f"_{name}" for name in values))


def one_range(df: DataFrame, order: str, chunk: int) -> bool:
    """Whether all positions are in the first range."""
    return (df.agg(F.max(order)).first()[0] or 0) < chunk


def carried_tails(rows: DataFrame, keys: Sequence[str], order: str, item: Column, k: int) -> DataFrame:
    """keys, range and `_tail`: the last k items (structs) of the ranges before, oldest first, for each range that has rows."""
    last = Window.partitionBy(*keys, RANGE).orderBy(F.col(order).desc())
    tails = rows.select(*keys, RANGE, F.col(order).alias("_at"), item.alias("_item")).withColumnRenamed("_at", order)
    tails = tails.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= k)
    # at most k items of a range; the last k ranges that have any are enough
    tails = tails.groupBy(*keys, RANGE).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_item").alias("item")))).alias("_own"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(-k, -1)
    joined = F.flatten(F.collect_list("_own").over(before))
    return tails.withColumn("_all", joined).select(*keys, RANGE, F.transform(F.slice("_all", F.greatest(F.size("_all") - k + 1, F.lit(1)), k), lambda x: x["item"]).alias("_tail"))


def items_before(df: DataFrame, keys: Sequence[str], order: str, item: Column, k: int, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`: an array of `item` (a struct) of the k rows of its key just before it, oldest first; of fewer where there are fewer."""
    if one_range(df, order, chunk):
        return df.withColumn(name, F.collect_list(item).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, -1)))
    rows = df.withColumn(RANGE, F.floor(F.col(order) / F.lit(chunk)))
    own = F.collect_list(item).over(Window.partitionBy(*keys, RANGE).orderBy(order).rowsBetween(-k, -1))
    out = rows.withColumn(name, own).join(carried_tails(rows, keys, order, item, k), [*keys, RANGE])
    both = F.concat("_tail", name)
    return out.withColumn(name, F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), k)).drop(RANGE, "_tail")


def last_before(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with `name`: the last value that isn't null among the earlier rows of its key."""
    frame = lambda *parts: Window.partitionBy(*keys, *parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if one_range(df, order, chunk):
        return df.withColumn(name, F.last(value, ignorenulls=True).over(frame()))
    rows = df.withColumn(RANGE, F.floor(F.col(order) / F.lit(chunk)))
    ranges = rows.groupBy(*keys, RANGE).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    ranges = ranges.select(*keys, RANGE, F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)).alias("_tail"))
    out = rows.withColumn(name, F.last(value, ignorenulls=True).over(frame(RANGE))).join(ranges, [*keys, RANGE])
    return out.withColumn(name, F.coalesce(name, "_tail")).drop(RANGE, "_tail")
