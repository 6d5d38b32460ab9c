"""Next-event detectors: which template follows a history, and how far parameters stray.

`KeyModel` learns from normal training sequences how often each template follows each history of `history`
templates and, for histories that training hasn't seen in full, each shorter ending down to `shortest`. An event is
anomalous if its template isn't among the `top` that follow; with `strict`, also if its history holds a template that
training hasn't seen. Both fitting and scoring are joins and aggregations;
sequences of any length are cut into (history, next) rows by window functions.

Parameter models follow each template's numeric parameters and time gaps: the residual to the mean of the last
`history` values, against a Gaussian bound learnt from the tail of the training series. `predict_jointly` asks them where the
key model found nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.text import numeric
from seqloom.operators.labels import is_anomalous
from seqloom.operators.ordinals import CHUNK
from seqloom.operators.running import items_before, sums_before
from seqloom.operators.sequences import with_time_gaps
from seqloom.schemas import TRAIN
from seqloom.storage import kept

FLOOR = 1e-8


def normal_training(members: DataFrame, sequences: DataFrame) -> DataFrame:
    good = sequences.where((F.col("split_label") == TRAIN) & ~is_anomalous(F.col("label"))).select("window_id")
    return members.join(good, "window_id")


def history_pairs(members: DataFrame, history: int, chunk: int = CHUNK) -> DataFrame:
    """window_id, pos, history (array) and target of every event with that many before it."""
    rows = members.select("window_id", "pos", F.col("template").alias("target"))
    rows = items_before(rows, ["window_id"], "pos", F.struct("target"), history, "history", chunk).where(F.col("pos") >= history)
    return rows.withColumn("history", F.transform("history", lambda x: x["target"]))


@dataclass(frozen=True)
class KeyModel:
    history: int = 10
    top: int = 9
    shortest: int = 1
    strict: bool = False

    def fit(self, members: DataFrame, sequences: DataFrame) -> FittedKeyModel:
        pairs = history_pairs(normal_training(members, sequences), self.history)
        endings = F.array(*(F.slice("history", self.history - n + 1, n) for n in range(self.shortest, self.history + 1)))
        counts = pairs.select(F.explode(endings).alias("ending"), "target").groupBy("ending", "target").agg(F.count("*").alias("n"))
        order = Window.partitionBy("ending").orderBy(F.col("n").desc(), "target")
        ranked = counts.withColumn("rank", F.row_number().over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("ending")))
        known = normal_training(members, sequences).select("template").distinct()
        return FittedKeyModel(self, kept(ranked.where(F.col("rank") <= self.top)), kept(known))


@dataclass(frozen=True)
class FittedKeyModel:
    config: KeyModel
    ranked: DataFrame
    vocabulary: DataFrame

    def candidates(self) -> DataFrame:
        """ending and candidates (best first, at most `top`)."""
        rows = self.ranked.groupBy("ending").agg(F.array_sort(F.collect_list(F.struct("rank", "target", (F.col("n") / F.col("all")).alias("p")))).alias("c"))
        return rows.select("ending", F.transform("c", lambda x: x["target"]).alias("candidates"), F.transform("c", lambda x: x["p"]).alias("shares"))

    def events(self, members: DataFrame) -> DataFrame:
        """window_id, pos, target, history, candidates, p (null for an unknown history) and anomalous."""
        h = self.config.history
        pairs = history_pairs(members, h)
        endings = F.array(*(F.slice("history", h - n + 1, n) for n in range(self.config.shortest, h + 1)))
        tried = pairs.select("window_id", "pos", "target", "history", F.explode(endings).alias("ending"))
        found = tried.join(self.candidates(), "ending", "left")
        best = found.groupBy("window_id", "pos").agg(F.first("target").alias("target"), F.first("history").alias("history"), F.max_by(F.struct("candidates", "shares"), F.when(F.col("candidates").isNotNull(), F.size("ending"))).alias("c"))
        place = F.array_position("c.candidates", F.col("target"))
        p = F.when(F.col("c").isNotNull(), F.when(place > 0, F.get(F.col("c.shares"), (place - 1).cast("int"))).otherwise(0.0))
        bad = F.coalesce(place, F.lit(0)) == 0
        if self.config.strict:
            seen = pairs.select("window_id", "pos", F.explode("history").alias("template"))
            unseen = seen.join(self.vocabulary, "template", "left_anti").select("window_id", "pos").distinct().withColumn("unseen", F.lit(True))
            best = best.join(unseen, ["window_id", "pos"], "left").withColumn("c", F.when(F.col("unseen").isNull(), F.col("c")))
        return best.select("window_id", "pos", "target", "history", F.coalesce(F.col("c.candidates"), F.array().cast("array<string>")).alias("candidates"), p.alias("p"), bad.alias("anomalous"))

    def predict(self, members: DataFrame, sequences: DataFrame) -> DataFrame:
        """Anomalous if any event is; the score is the largest 1 - p of anomalous events, else 0."""
        signal = F.when(F.col("anomalous"), 1 - F.coalesce("p", F.lit(0.0))).otherwise(0.0)
        found = self.events(members).groupBy("window_id").agg(F.max(F.col("anomalous").cast("int")).alias("predicted_label"), F.max(signal).alias("score"))
        out = sequences.join(found, "window_id", "left")
        return out.withColumns({"predicted_label": F.coalesce("predicted_label", F.lit(0)), "score": F.round(F.coalesce("score", F.lit(0.0)), 8)})


def parameter_values(members: DataFrame) -> DataFrame:
    """window_id, pos, template, feature (dt_prev_ms, param_0, ...) and value (null where it isn't a number)."""
    rows = with_time_gaps(members, "_dt").withColumn("_dt", F.col("_dt").cast("double"))
    params = rows.select("window_id", "pos", "template", F.posexplode("params").alias("i", "text")).select("window_id", "pos", "template", F.concat(F.lit("param_"), F.col("i")).alias("feature"), numeric(F.col("text")).alias("value"))
    gaps = rows.where("_dt IS NOT NULL").select("window_id", "pos", "template", F.lit("dt_prev_ms").alias("feature"), F.col("_dt").alias("value"))
    return params.unionByName(gaps)


def parameter_schema(values: DataFrame) -> DataFrame:
    """template, feature and kept: whether it was a number each time."""
    return values.groupBy("template", "feature").agg(F.bool_and(F.col("value").isNotNull()).alias("kept"))


def normalisation(values: DataFrame, schema: DataFrame) -> DataFrame:
    """template, feature, mean and std (population, variance no less than 1e-8) of the kept features."""
    kept = values.join(schema.where("kept").select("template", "feature"), ["template", "feature"])
    return kept.groupBy("template", "feature").agg(F.avg("value").alias("mean"), F.sqrt(F.greatest(F.var_pop("value"), F.lit(FLOOR))).alias("std"))


def gaussian_bounds(residuals: DataFrame, confidence: float = 0.98) -> DataFrame:
    """template, lower (no less than 0) and upper bound of residuals: mean and z standard deviations."""
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    rows = residuals.groupBy("template").agg(F.avg("residual").alias("m"), F.sqrt(F.var_pop("residual")).alias("s"))
    return rows.select("template", F.greatest(F.col("m") - z * F.col("s"), F.lit(0.0)).alias("lower"), (F.col("m") + z * F.col("s")).alias("upper"))


def masked_mse(predicted: Column, actual: Column, mask: Column) -> Column:
    """Mean squared error over the places that the mask has; 0 where it has none."""
    parts = F.filter(F.arrays_zip(predicted.alias("p"), actual.alias("a"), mask.alias("m")), lambda x: x["m"])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + (x["p"] - x["a"]) * (x["p"] - x["a"]))
    return F.coalesce(F.try_divide(total, F.size(parts)), F.lit(0.0))


def tail_size(pairs: int, fraction: float) -> int:
    """Validation pairs of a series: the last ceil(pairs * fraction), one at least and all but one at most."""
    return min(max(1, math.ceil(pairs * fraction)), pairs - 1)


@dataclass(frozen=True)
class ParameterModel:
    history: int = 2
    validation: float = 0.3
    confidence: float = 0.98
    chunk: int = CHUNK

    def guesses(self, values: DataFrame, scale: DataFrame) -> DataFrame:
        """values with x (normalised), guess (the mean of the last `history` in its series), mean and std, where there are as many before."""
        rows = values.join(scale, ["template", "feature"]).withColumn("x", (F.col("value") - F.col("mean")) / F.col("std"))
        rows = items_before(rows, ["window_id", "template", "feature"], "pos", F.struct("x"), self.history, "past", self.chunk)
        known = F.filter(F.transform("past", lambda p: p["x"]), lambda x: x.isNotNull())
        guess = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
        return rows.where(F.size(known) == self.history).withColumn("guess", guess).drop("past")

    def series(self, values: DataFrame, scale: DataFrame) -> DataFrame:
        """window_id, pos, template and residual: mean squared distance of an event's values to their guesses, over its features."""
        rows = self.guesses(values, scale)
        error = (F.col("x") - F.col("guess")) * (F.col("x") - F.col("guess"))
        return rows.groupBy("window_id", "pos", "template").agg(F.avg(error).alias("residual"))

    def parts(self, members: DataFrame) -> DataFrame:
        """window_id, pos, template and validation (whether the event is in the tail) of the events of each series: those of one template in one sequence.

        Of the pairs of a series (events with `history` before them) the last are held out; what is before the first of these is the prefix.
        Series of fewer than two pairs take no part.
        """
        keys = ["window_id", "template"]
        events = members.select(*keys, "pos", F.lit(1).alias("_one"))
        events = sums_before(events, keys, "pos", {"i": "_one"}, self.chunk).join(events.groupBy(*keys).agg(F.count("*").alias("n")), keys)
        pairs = F.col("n") - self.history
        tail = F.least(F.greatest(F.ceil(pairs * F.lit(float(self.validation))), F.lit(1)), pairs - 1)
        return events.where(pairs >= 2).select(*keys, "pos", (F.col("i") >= F.col("n") - tail).alias("validation"))

    def fit(self, members: DataFrame, sequences: DataFrame) -> FittedParameterModel:
        """Scales come from the prefixes, bounds from the residuals of the tails."""
        train = normal_training(members, sequences)
        values, parts, at = kept(parameter_values(train)), kept(self.parts(train)), ["window_id", "pos", "template"]
        scale = kept(normalisation(values.join(parts.where("NOT validation"), at), parameter_schema(values)))
        tails = self.series(values, scale).join(parts.where("validation"), at, "left_semi")
        return FittedParameterModel(self, scale, kept(gaussian_bounds(tails, self.confidence)))


@dataclass(frozen=True)
class FittedParameterModel:
    config: ParameterModel
    scale: DataFrame
    bounds: DataFrame

    def events(self, members: DataFrame) -> DataFrame:
        series = self.config.series(parameter_values(members), self.scale)
        return series.join(self.bounds, "template").select("window_id", "pos", "template", "residual", (F.col("residual") - F.col("upper")).alias("margin"), (F.col("residual") > F.col("upper")).alias("anomalous"))


    def explained(self, members: DataFrame) -> DataFrame:
        """window_id, pos, template and the feature whose value is furthest from its guess, with both as they were before normalising; of equal ones the first by name."""
        rows = self.config.guesses(parameter_values(members), self.scale).where("x IS NOT NULL")
        expected = F.col("guess") * F.col("std") + F.col("mean")
        off = F.abs(F.col("value") - expected)
        best = F.min_by(F.struct("feature", F.col("value").alias("observed"), expected.alias("expected")), F.struct((-off).alias("off"), "feature"))
        return rows.groupBy("window_id", "pos", "template").agg(best.alias("b")).select("window_id", "pos", "template", "b.*")


def predict_jointly(keys: FittedKeyModel, parameters: FittedParameterModel, members: DataFrame, sequences: DataFrame) -> DataFrame:
    """Anomalous if any event's key is, or its parameters where its key passed; the score is the largest of 1 - p of anomalous keys and margins above the bound, else 0."""
    events = keys.events(members).select("window_id", "pos", F.col("anomalous").alias("key"), "p")
    strays = parameters.events(members).select("window_id", "pos", F.col("anomalous").alias("stray"), "margin")
    both = events.join(strays, ["window_id", "pos"], "left")
    stray = ~F.col("key") & F.coalesce("stray", F.lit(False))
    signal = F.when(F.col("key"), 1 - F.coalesce("p", F.lit(0.0))).when(stray, F.col("margin")).otherwise(0.0)
    found = both.groupBy("window_id").agg(F.max((F.col("key") | stray).cast("int")).alias("predicted_label"), F.max(signal).alias("score"))
    out = sequences.join(found, "window_id", "left")
    return out.withColumns({"predicted_label": F.coalesce("predicted_label", F.lit(0)), "score": F.round(F.coalesce("score", F.lit(0.0)), 8)})
