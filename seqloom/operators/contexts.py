"""Context detectors: an event is judged by the events before it.

A context is the last `size` templates of the sequence before the event, filled with a placeholder on the left;
templates that lie more than `timeout_ms` back count as the placeholder too, unless a time is missing between.
Training groups events by template and set of context templates; a group of at least `min_samples` has the largest
label of its events as score. Unknown templates give -2, contexts in no group -3, and groups that are too small -1;
each means that the detector abstains.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.labels import is_anomalous
from seqloom.operators.ordinals import CHUNK
from seqloom.operators.running import items_before, sums_before
from seqloom.operators.sequences import with_time_gaps
from seqloom.schemas import TRAIN
from seqloom.storage import kept

NO_EVENT = "<no event>"
NOT_CONFIDENT, UNKNOWN_EVENT, FAR_CONTEXT = -1.0, -2.0, -3.0
REASONS = {NOT_CONFIDENT: "not_confident_enough", UNKNOWN_EVENT: "event_not_in_training_vocabulary", FAR_CONTEXT: "closest_cluster_outside_epsilon"}


def contexts(members: DataFrame, sequences: DataFrame, size: int = 10, timeout_ms: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """window_id, pos, template, context (array, oldest first), truth and fallback (whether truth is the sequence's label)."""
    rows, item = members, F.struct("template")
    if timeout_ms is not None:
        rows = with_time_gaps(members, "_dt", chunk).withColumns({"_ms": F.coalesce("_dt", F.lit(0)), "_open": F.col("_dt").isNull().cast("long")})
        rows = sums_before(rows, ["window_id"], "pos", {"_sum": "_ms", "_gaps": "_open"}, chunk)
        rows = rows.withColumns({"_sum": F.col("_sum") + F.col("_ms"), "_gaps": F.col("_gaps") + F.col("_open")})
        item = F.struct("template", "_sum", "_gaps")
    rows = items_before(rows, ["window_id"], "pos", item, size, "_past", chunk)

    def name(x: Column) -> Column:
        known = F.coalesce(x["template"], F.lit(NO_EVENT))
        if timeout_ms is None:
            return known
        stale = (F.col("_sum") - x["_sum"] > timeout_ms) & (F.col("_gaps") == x["_gaps"])
        return F.when(stale, NO_EVENT).otherwise(known)

    rows = rows.withColumn("context", F.concat(F.array_repeat(F.lit(NO_EVENT), (size - F.size("_past")).cast("int")), F.transform("_past", name)))
    labelled = rows.join(sequences.select("window_id", "label", "split_label"), "window_id")
    # a sequence without any event label has its own label for all its events; so has an event without one
    truth = F.coalesce(is_anomalous(F.when(F.col("anomalous").isNotNull(), F.col("anomalous"))).cast("int"), F.col("label"))
    truth = F.when(F.col("anomalous").isNull(), F.col("label")).otherwise(truth)
    return labelled.select("window_id", "pos", "template", "context", truth.alias("truth"), F.col("anomalous").isNull().alias("fallback"), "split_label")


def reason(score: Column) -> Column:
    out = F.when(score > 0, "known_malicious_cluster")
    for value, name in REASONS.items():
        out = out.when(F.abs(score - value) < 1e-9, name)
    return out.otherwise("known_benign_cluster")


def bag(context: Column) -> Column:
    """The different templates of a context as a string."""
    return F.array_join(F.array_sort(F.array_distinct(context)), "\x1f")


def by_sequence(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Anomalous with any malicious event; else abstained with any abstention; else normal. The score is the largest positive one."""
    found = events.groupBy("window_id").agg(F.max("score").alias("top"), F.min("score").alias("low"))
    out = sequences.join(found, "window_id", "left")
    bad = F.coalesce(F.col("top") > 0, F.lit(False))
    return out.withColumns({"predicted_label": bad.cast("int"), "abstained": ~bad & F.coalesce(F.col("low") < 0, F.lit(False)), "score": F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0))}).drop("top", "low")


def top_templates(contexts: DataFrame, k: int) -> DataFrame:
    """context, rank (from 1), template and n: the k templates that follow each context most often, ties by name.

    Each task keeps the first k of its counts of a context, and what the tasks have kept is merged.
    """
    counts = contexts.groupBy("context", "template").agg(F.count("*").alias("n"))
    order = Window.partitionBy("context").orderBy(F.col("n").desc(), "template")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("context", "rank", "template", "n")


def next_candidates(asked: DataFrame, top: DataFrame) -> DataFrame:
    """asked (template, context, ...) with actual, candidates (best first; none for an unknown context) and history, as next-event metrics take them."""
    # at most k rows of a context
    best = top.groupBy("context").agg(F.array_sort(F.collect_list(F.struct("rank", "template"))).alias("c")).select("context", F.transform("c", lambda x: x["template"]).alias("candidates"))
    found = asked.join(best, "context", "left")
    return found.withColumns({"actual": F.col("template"), "history": F.col("context"), "candidates": F.coalesce("candidates", F.array().cast("array<string>"))})


@dataclass(frozen=True)
class ContextModel:
    size: int = 10
    timeout_ms: int | None = 86_400_000
    min_samples: int = 5

    def fit(self, members: DataFrame, sequences: DataFrame) -> FittedContextModel:
        train = contexts(members, sequences, self.size, self.timeout_ms).where(F.col("split_label") == TRAIN)
        groups = train.groupBy("template", bag(F.col("context")).alias("bag")).agg(F.count("*").alias("n"), F.max("truth").cast("double").alias("worst"))
        return FittedContextModel(self, kept(groups))


@dataclass(frozen=True)
class FittedContextModel:
    config: ContextModel
    groups: DataFrame

    def events(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        """window_id, pos, template, truth and score."""
        rows = contexts(members, sequences, self.config.size, self.config.timeout_ms).withColumn("bag", bag(F.col("context")))
        known = self.groups.select("template").distinct().withColumn("seen", F.lit(True))
        found = rows.join(self.groups, ["template", "bag"], "left").join(known, "template", "left")
        score = F.when(F.col("seen").isNull(), UNKNOWN_EVENT).when(F.col("n").isNull(), FAR_CONTEXT).when(F.col("n") < self.config.min_samples, NOT_CONFIDENT).otherwise(F.col("worst"))
        return found.select("window_id", "pos", "template", "truth", "split_label", score.alias("score"))

    def predict(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        return by_sequence(self.events(members, sequences), sequences)
