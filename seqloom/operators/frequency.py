"""Template frequency: rare templates make a sequence anomalous.

score = mean of -ln((count + alpha) / (N + alpha * V)) over a sequence's events, 0 for an empty one; counts over
training events. The threshold is given, or the nearest-rank quantile of the scores of normal training
sequences (of all training sequences where none is normal). Above it is anomalous.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.labels import is_anomalous
from seqloom.operators.ordinals import in_ranges
from seqloom.schemas import TRAIN
from seqloom.storage import kept


def nearest_rank(values: DataFrame, column: str, q: float) -> float | None:
    """The ceil(q * n)-th smallest value; null ones don't count. Equal values are counted together first."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    ranges = in_ranges(counts, [F.col(column)])
    # one row per partition
    sizes = sorted((r["_part"], r["n"]) for r in ranges.groupBy("_part").agg(F.sum("c").alias("n")).collect())
    total = sum(n for _, n in sizes)
    rank = min(total, max(1, math.ceil(q * total)))
    for part, n in sizes:
        if rank <= n:
            before = Window.orderBy(column)
            return ranges.where(F.col("_part") == part).withColumn("upto", F.sum("c").over(before)).where(F.col("upto") >= rank).agg(F.min(column).alias("v")).first()["v"]
        rank -= n
    return None


@dataclass(frozen=True)
class TemplateFrequency:
    smoothing: float = 1.0
    quantile: float = 0.95
    threshold: float | None = None

    def fit(self, members: DataFrame, sequences: DataFrame) -> TemplateFrequencyModel:
        train = members.join(sequences.where(F.col("split_label") == TRAIN).select("window_id"), "window_id")
        counts = kept(train.groupBy("template").agg(F.count("*").alias("cnt")))
        sums = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"), F.count("*").alias("vocabulary")).first()
        model = TemplateFrequencyModel(counts, sums["total"], sums["vocabulary"], self.smoothing, self.threshold)
        if self.threshold is None:
            scores = kept(model.scores(members, sequences.where(F.col("split_label") == TRAIN)).select("label", "score"))
            normal = scores.where(~is_anomalous(F.col("label")))
            value = nearest_rank(normal, "score", self.quantile)
            value = nearest_rank(scores, "score", self.quantile) if value is None else value
            model = replace(model, threshold=value if value is not None else 0.0)
        return model


@dataclass(frozen=True)
class TemplateFrequencyModel:
    counts: DataFrame
    total: int
    vocabulary: int
    smoothing: float
    threshold: float | None

    def scores(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        own = members.join(sequences.select("window_id"), "window_id", "left_semi").groupBy("window_id", "template").agg(F.count("*").alias("n"))
        rows = own.join(self.counts, "template", "left")
        surprise = -F.log((F.coalesce("cnt", F.lit(0)) + self.smoothing) / F.lit(self.total + self.smoothing * self.vocabulary))
        scored = rows.groupBy("window_id").agg((F.sum(surprise * F.col("n")) / F.sum("n")).alias("score"))
        # rounded so that the order of addition decides no comparison with the threshold
        return sequences.join(scored, "window_id", "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 10))

    def predict(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        return self.scores(members, sequences).withColumn("predicted_label", (F.col("score") > F.lit(self.threshold)).cast("int"))
