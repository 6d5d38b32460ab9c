"""Naive Bayes on phrase counts: multinomial with explanations, and the Bernoulli and complement forms.

All three are sums over (class, phrase) counts, so they are fitted by one aggregation and applied by one join.
Phrases that training hasn't seen count with the smoothing alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.labels import is_anomalous
from seqloom.schemas import TRAIN
from seqloom.storage import kept

MULTINOMIAL, BERNOULLI, COMPLEMENT = "multinomial", "bernoulli", "complement"
#: Phrases that are ranked in one task.
ROWS = 500_000


@dataclass(frozen=True)
class NaiveBayes:
    form: str = MULTINOMIAL
    smoothing: float = 1.0
    top_k: int = 5
    threshold: float = 0.5

    def fit(self, features: DataFrame, sequences: DataFrame) -> NaiveBayesModel:
        """features: window_id, feature, cnt. An error unless training has both classes."""
        train = sequences.where(F.col("split_label") == TRAIN).select("window_id", is_anomalous(F.col("label")).cast("int").alias("label"))
        sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if set(sizes) != {0, 1}:
            raise ValueError("naive Bayes needs normal and anomalous sequences in training")
        one = F.lit(1) if self.form == BERNOULLI else F.col("cnt")
        rows = features.join(train, "window_id")
        own = lambda c: F.sum(F.when(F.col("label") == c, one).otherwise(0))
        counts = kept(rows.groupBy("feature").agg(own(0).alias("c0"), own(1).alias("c1")))
        sums = counts.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.count("*").alias("v")).first()
        return NaiveBayesModel(self, counts, {"t0": sums["t0"] or 0, "t1": sums["t1"] or 0, "v": sums["v"], "n0": sizes[0], "n1": sizes[1]})


@dataclass(frozen=True)
class NaiveBayesModel:
    config: NaiveBayes
    counts: DataFrame
    #: t0, t1: phrases of each class; v: different phrases; n0, n1: sequences of each class.
    totals: dict[str, int]

    def total(self, name: str) -> Column:
        return F.lit(self.totals[name])

    def log_odds(self) -> Column:
        """ln P(phrase | anomalous) and ln P(phrase | normal) as a struct."""
        a = self.config.smoothing
        c0, c1 = F.coalesce("c0", F.lit(0)), F.coalesce("c1", F.lit(0))
        if self.config.form == BERNOULLI:
            p0, p1 = (c0 + a) / (self.total("n0") + 2 * a), (c1 + a) / (self.total("n1") + 2 * a)
            return F.struct(F.log(p0).alias("l0"), F.log(p1).alias("l1"))
        size = max(self.totals["v"], 1)
        l0, l1 = F.log((c0 + a) / F.lit(self.totals["t0"] + a * size)), F.log((c1 + a) / F.lit(self.totals["t1"] + a * size))
        # the complement form weighs a class by how badly the other one explains the phrase
        return F.struct((-l1).alias("l0"), (-l0).alias("l1")) if self.config.form == COMPLEMENT else F.struct(l0.alias("l0"), l1.alias("l1"))

    def weighted(self, features: DataFrame) -> DataFrame:
        return features.join(self.counts, "feature", "left").withColumn("l", self.log_odds())

    def predict(self, features: DataFrame, sequences: DataFrame) -> DataFrame:
        """sequences with score (posterior of anomalous) and predicted_label."""
        prior0 = F.log(self.total("n0") / (self.total("n0") + self.total("n1")))
        prior1 = F.log(self.total("n1") / (self.total("n0") + self.total("n1")))
        if self.config.form == BERNOULLI:
            a = self.config.smoothing
            absent = lambda c, n: F.log(1 - (F.col(c) + a) / (self.total(n) + 2 * a))
            base = self.counts.agg(F.sum(absent("c0", "n0")).alias("b0"), F.sum(absent("c1", "n1")).alias("b1"))
            # only phrases of the vocabulary count; those that are there replace their absence
            rows = features.join(self.counts, "feature").withColumn("l", self.log_odds())
            sums = rows.groupBy("window_id").agg(F.sum(F.col("l.l0") - absent("c0", "n0")).alias("s0"), F.sum(F.col("l.l1") - absent("c1", "n1")).alias("s1"))
            joined = sequences.join(sums, "window_id", "left").join(F.broadcast(base))
            s0, s1 = F.coalesce("s0", F.lit(0.0)) + F.col("b0") + prior0, F.coalesce("s1", F.lit(0.0)) + F.col("b1") + prior1
        else:
            sums = self.weighted(features).groupBy("window_id").agg(F.sum(F.col("cnt") * F.col("l.l0")).alias("s0"), F.sum(F.col("cnt") * F.col("l.l1")).alias("s1"))
            joined = sequences.join(sums, "window_id", "left")
            s0, s1 = F.coalesce("s0", F.lit(0.0)), F.coalesce("s1", F.lit(0.0))
            if self.config.form == MULTINOMIAL:
                s0, s1 = s0 + prior0, s1 + prior1
        top = F.greatest(s0, s1)
        posterior = F.round(F.exp(s1 - top) / (F.exp(s0 - top) + F.exp(s1 - top)), 10)
        out = joined.withColumn("score", posterior)
        return out.select(*sequences.columns, "score", (F.col("score") >= self.config.threshold).cast("int").alias("predicted_label"))

    def key_phrases(self, features: DataFrame, predictions: DataFrame, rows: int = ROWS) -> DataFrame:
        """window_id, rank and feature: the phrases that speak most for the prediction; those that speak against it only where none speaks for it. Sequences are dealt to tasks of about `rows` phrases."""
        tasks = max(-(-features.count() // rows), features.sparkSession.sparkContext.defaultParallelism)
        weights = self.weighted(features).select("window_id", "feature", (F.col("cnt") * (F.col("l.l1") - F.col("l.l0"))).alias("weight"))
        signs = predictions.select("window_id", F.when(F.col("predicted_label") == 1, 1).otherwise(-1).alias("sign"))
        found = weights.repartition(tasks, "window_id").join(signs.repartition(tasks, "window_id"), "window_id")
        found = found.select("window_id", "feature", F.round(F.col("weight") * F.col("sign"), 10).alias("lean"))
        found = found.withColumn("tokens", F.length("feature") - F.length(F.replace("feature", F.lit(" "), F.lit(""))) + 1)
        order = [F.round(F.col("lean") * F.col("tokens"), 8).desc(), F.col("lean").desc(), F.col("tokens").desc(), F.col("feature").desc()]
        # those that speak for it come first, so the first top_k tell whether there are any
        per = Window.partitionBy("window_id")
        top = found.withColumn("rank", F.row_number().over(per.orderBy((F.col("lean") > 0).desc(), *order))).where(F.col("rank") <= self.config.top_k)
        return top.withColumn("any", F.max(F.col("lean") > 0).over(per)).where(~F.col("any") | (F.col("lean") > 0)).select("window_id", "rank", "feature")

    def global_phrases(self, label: int) -> DataFrame:
        """The top phrases of a class."""
        rows = self.counts.withColumn("l", self.log_odds())
        lean = F.round((F.col("l.l1") - F.col("l.l0")) * (1 if label else -1), 10)
        tokens = F.length("feature") - F.length(F.replace("feature", F.lit(" "), F.lit(""))) + 1
        rows = rows.withColumn("lean", lean).withColumn("tokens", tokens)
        return rows.orderBy((F.col("lean") * F.col("tokens")).desc(), F.col("lean").desc(), F.col("tokens").desc(), F.col("feature").desc()).limit(self.config.top_k).select("feature", "lean")
