"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.storage import kept


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all nodes of edges (u, v) between different nodes.

    A round ties each node's larger neighbours, then the node and its smaller ones, to the smallest of them. Every step is a minimum by
    node and a join with it, so a node with very many neighbours is summed before rows move.
    """
    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(ways.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = kept(large.groupBy("u").agg(F.min("v").alias("m")))
        tied = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = kept(tied.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        if small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("label"))
        edges = small
