"""Confusion counts, their ratios, label histograms, next-event and decision metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.labels import is_anomalous
from seqloom.schemas import TEST
from seqloom.storage import kept


#: Which events next-event diagnostics count: all, or those that training's templates suffice for.
FULL_DATASET, TRAIN_ONLY = "full_dataset", "train_only"


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def run_metrics(predictions: DataFrame) -> DataFrame:
    """One row over test predictions (label, predicted_label, score, abstained where there is such a column).

    Sequences that the detector abstained from are in the mean score but not in the confusion counts.
    """
    rows = predictions.where(F.col("split_label") == TEST)
    decided = ~F.coalesce(F.col("abstained"), F.lit(False)) if "abstained" in predictions.columns else F.lit(True)
    truth, said = is_anomalous(F.col("label")), F.col("predicted_label") != 0
    cells = rows.agg(
        F.count_if(decided & truth & said).alias("tp"),
        F.count_if(decided & ~truth & ~said).alias("tn"),
        F.count_if(decided & ~truth & said).alias("fp"),
        F.count_if(decided & truth & ~said).alias("fn"),
        F.count_if(~decided).alias("abstained"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return cells.select(
        "tp", "tn", "fp", "fn", "abstained",
        F.round(ratio(tp + tn, tp + tn + fp + fn), 8).alias("accuracy"),
        F.round(precision, 8).alias("precision"),
        F.round(recall, 8).alias("recall"),
        F.round(ratio(2 * precision * recall, precision + recall), 8).alias("f1"),
        F.round("mean_score", 8).alias("mean_score"),
    )


def label_histograms(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("split_label", "label").agg(F.count("*").alias("n"))


def next_event_metrics(predictions: DataFrame, ks: tuple[int, ...] = (1, 2, 5), known: DataFrame | None = None, policy: str = FULL_DATASET, padding: str | None = None, insufficient: int = 0) -> dict[str, DataFrame]:
    """predictions: actual, candidates (best first), and history (the templates it was made from) where the policy asks for it.

    With `full_dataset` each event counts; one without candidates, as of a history that training doesn't know, is a miss. With `train_only`
    events whose target, then those whose history, has a template that isn't among `known` (the templates of training) are
    excluded; a place that `padding` fills is such a history. insufficient: events that had too few before them to be asked for; they
    are seen and never eligible. Gives frames `topk` (eligible and hits), `labels` (one row per actual label) and `summary` (one row).
    """
    if policy not in (FULL_DATASET, TRAIN_ONLY):
        raise ValueError(f"unknown vocabulary policy {policy!r}")
    rows = predictions
    if policy == TRAIN_ONLY:
        if known is None:
            raise ValueError("train_only needs the known templates")
        names = known.select("template").distinct()
        names = names if padding is None else names.where(F.col("template") != padding)
        # written once: numbers of a plan that runs again could be others
        rows = kept(rows.withColumn("_id", F.monotonically_increasing_id()))
        rows = rows.join(names.select(F.col("template").alias("actual"), F.lit(True).alias("_seen")), "actual", "left")
        unknown = rows.select("_id", F.explode("history").alias("template")).join(names, "template", "left_anti").select("_id").distinct().withColumn("_gap", F.lit(True))
        rows = rows.join(unknown, "_id", "left").withColumn("reason", F.when(F.col("_seen").isNull(), "unknown_target").when(F.col("_gap"), "unknown_history")).drop("_seen", "_gap", "_id")
    else:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    fine = rows.where("reason IS NULL").withColumn("predicted", F.get("candidates", F.lit(0)))
    topk = fine.agg(F.count("*").alias("eligible"), *(F.count_if(F.array_contains(F.slice("candidates", 1, k), F.col("actual"))).alias(f"hit_{k}") for k in ks))
    cells = fine.groupBy(F.col("actual").alias("template")).agg(F.count("*").alias("support"), F.count_if(F.col("predicted") == F.col("actual")).alias("tp"))
    said = fine.where("predicted IS NOT NULL").groupBy(F.col("predicted").alias("template")).agg(F.count("*").alias("said"))
    labels = cells.join(said, "template", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    p, r = ratio(F.col("tp"), F.col("said")), ratio(F.col("tp"), F.col("support"))
    labels = labels.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    n = F.sum("support")
    summary = labels.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(ratio(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")))
    counts = rows.agg((F.count("*") + insufficient).alias("events"), F.lit(insufficient).cast("long").alias("insufficient_history"), F.count_if(F.col("reason").isNull()).alias("eligible"), *(F.count_if(F.col("reason") == x).alias(x) for x in ("unknown_target", "unknown_history")))
    counts = counts.withColumn("coverage", ratio(F.col("eligible"), F.col("events")))
    return {"topk": topk, "labels": labels, "summary": summary.crossJoin(counts)}


def decision_summary(events: DataFrame) -> DataFrame:
    """Event decisions (score, truth): a positive score is malicious, 0 benign, -1, -2 and -3 abstain."""
    bad, good = F.col("score") > 0, F.col("score") == 0
    truth = is_anomalous(F.col("truth"))
    cells = events.agg(F.count("*").alias("events"), F.count_if(F.col("score") < 0).alias("abstained"), F.count_if(bad & truth).alias("tp"), F.count_if(bad & ~truth).alias("fp"), F.count_if(good & ~truth).alias("tn"), F.count_if(good & truth).alias("fn"))
    return cells.withColumn("coverage", F.round(ratio(F.col("events") - F.col("abstained"), F.col("events")), 8))
