"""Density clusters of contexts.

The contexts of one template are points; two are neighbours if at most a share `eps` of their places differ, whatever the order: a
context is a bag of `size` templates, and the distance of two bags is one less the share that they have in common. A point with at
least `min_samples` events within eps (its own included) is a core; cores that are neighbours are of one cluster; another point
within eps of a core is on the border of the core's cluster that it is nearest to (ties to the first core by name); what is left is noise.

Equal bags are one point with a weight from the start. Neighbours are found by a prefix filter: bags of one size that have t places
in common share one of their size - t + 1 rarest entries, whatever the rest is. So points meet by (template, entry of the prefix),
and a pair is kept only where it meets first, which gives each pair once. Entries are rare by choice, so these keys are small; what is
not is a skewed equi-join, which adaptive execution splits. Clusters are the components of the links between cores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.contexts import FAR_CONTEXT, NOT_CONFIDENT, UNKNOWN_EVENT, by_sequence, contexts
from seqloom.operators.graphs import components
from seqloom.schemas import TRAIN
from seqloom.storage import kept

MARK = "\x1f"


def entries(context: Column) -> Column:
    """A bag as a set: each template with the number of its occurrence."""
    ordered = F.array_sort(context)
    return F.transform(ordered, lambda x, i: F.concat(x, F.lit(MARK), (i + 2 - F.array_position(ordered, x)).cast("string")))


def bag_name(context: Column) -> Column:
    return F.array_join(F.array_sort(context), MARK)


def common_places(size: int, eps: float) -> int:
    """How many places two bags have in common at least if they are within eps."""
    if not 0 <= eps < 1:
        raise ValueError(f"eps must be at least 0 and less than 1: {eps}")
    return max(1, math.ceil(size * (1 - eps) - 1e-9))


def with_prefix(points: DataFrame, often: DataFrame, size: int, least: int) -> DataFrame:
    """points (point, template, entries) with `prefix`, the rarest entries, of which two bags that are near enough share one. often: template, entry, n."""
    rows = points.select("point", "template", F.explode("entries").alias("entry")).join(often, ["template", "entry"], "left")
    # at most `size` entries of a point
    order = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "entry"))), 1, size - least + 1)
    prefix = rows.groupBy("point").agg(order.alias("p")).select("point", F.transform("p", lambda x: x["entry"]).alias("prefix"))
    return points.join(prefix, "point")


def near(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """point, other and common (places in common) of all points of left and right that have at least `least` in common; both with template, entries and prefix."""
    a = left.select("point", "template", F.col("entries").alias("own"), F.col("prefix").alias("first"), F.explode("prefix").alias("key"))
    b = right.select(F.col("point").alias("other"), "template", "entries", "prefix", F.explode("prefix").alias("key"))
    # prefixes are in one order, so the first common entry is the same from both sides
    met = a.join(b, ["template", "key"]).where(F.get(F.array_intersect("first", "prefix"), F.lit(0)) == F.col("key"))
    return met.withColumn("common", F.size(F.array_intersect("own", "entries"))).where(F.col("common") >= least).select("point", "other", "common")


@dataclass(frozen=True)
class ClusteredContexts:
    """size: templates of a context; eps: share of places that neighbours may differ in."""

    size: int = 10
    timeout_ms: int | None = 86_400_000
    min_samples: int = 5
    eps: float = 0.1

    def fit(self, members: DataFrame, sequences: DataFrame) -> FittedClusters:
        least = common_places(self.size, self.eps)
        train = contexts(members, sequences, self.size, self.timeout_ms).where(F.col("split_label") == TRAIN)
        bags = train.groupBy("template", bag_name(F.col("context")).alias("bag")).agg(F.count("*").alias("n"), F.max("truth").alias("worst"))
        points = kept(bags.withColumn("point", F.monotonically_increasing_id()).withColumn("entries", entries(F.split("bag", MARK))))
        often = kept(points.select("template", F.explode("entries").alias("entry")).groupBy("template", "entry").agg(F.count("*").alias("n")))
        points = kept(with_prefix(points, often, self.size, least))
        pairs = kept(near(points, points, least))
        # a point is its own neighbour
        around = pairs.join(points.select(F.col("point").alias("other"), "n"), "other").groupBy("point").agg(F.sum("n").alias("around"))
        known = kept(points.join(around, "point").select("point", "template", "bag", "n", "worst", (F.col("around") >= self.min_samples).alias("core")))
        cores = known.where("core")
        from_core = pairs.join(cores.select(F.col("point").alias("other"), F.col("bag").alias("core_bag")), "other")
        links = from_core.join(cores.select("point"), "point", "left_semi").where("point < other").select(F.col("point").alias("u"), F.col("other").alias("v"))
        joined = components(links).select(F.col("node").alias("point"), "label")
        label = kept(cores.select("point", "bag").join(joined, "point", "left").select("point", "bag", F.coalesce("label", "point").alias("label")))
        names = label.groupBy("label").agg(F.min("bag").alias("cluster"))
        label = kept(label.join(names, "label").select("point", "cluster"))
        nearest = from_core.groupBy("point").agg(F.min(F.struct((-F.col("common")).alias("c"), "core_bag", "other"))["other"].alias("by"))
        border = nearest.join(known.where("NOT core").select("point"), "point", "left_semi").join(label.withColumnRenamed("point", "by"), "by").select("point", "cluster")
        clustered = known.join(label.unionByName(border), "point", "left")
        score = clustered.where("cluster IS NOT NULL").groupBy("template", "cluster").agg(F.max("worst").cast("double").alias("cluster_score"), F.sum("n").alias("cluster_events"))
        out = clustered.join(score, ["template", "cluster"], "left")
        return FittedClusters(self, kept(out.join(points.select("point", "entries", "prefix"), "point")), often)


@dataclass(frozen=True)
class FittedClusters:
    """points: point, template, bag, n (events), worst (largest label), core, cluster (the first core's bag; null for noise), cluster_score and cluster_events."""

    config: ClusteredContexts
    points: DataFrame
    often: DataFrame

    @property
    def groups(self) -> DataFrame:
        return self.points

    def events(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        """window_id, pos, template, truth, split_label and score: that of the cluster which the nearest training context within eps is of (ties to the first by name)."""
        least = common_places(self.config.size, self.config.eps)
        rows = contexts(members, sequences, self.config.size, self.config.timeout_ms).withColumn("bag", bag_name(F.col("context")))
        asked = kept(rows.select("template", "bag").distinct().withColumn("point", F.monotonically_increasing_id()).withColumn("entries", entries(F.split("bag", MARK))))
        met = near(with_prefix(asked, self.often, self.config.size, least), self.points, least)
        best = met.join(self.points.select(F.col("point").alias("other"), "bag", "cluster_score"), "other").groupBy("point").agg(F.min(F.struct((-F.col("common")).alias("c"), "bag", "cluster_score")).alias("b"))
        scored = asked.select("point", "template", "bag").join(best.select("point", F.lit(True).alias("near"), F.col("b.cluster_score").alias("own")), "point", "left")
        known = self.points.select("template").distinct().withColumn("seen", F.lit(True))
        scored = scored.join(known, "template", "left")
        score = F.when(F.col("seen").isNull(), UNKNOWN_EVENT).when(F.col("near").isNull(), FAR_CONTEXT).otherwise(F.coalesce("own", F.lit(NOT_CONFIDENT)))
        scored = scored.select("template", "bag", score.alias("score"))
        return rows.join(scored, ["template", "bag"]).select("window_id", "pos", "template", "truth", "split_label", "score")

    def predict(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        return by_sequence(self.events(members, sequences), sequences)
