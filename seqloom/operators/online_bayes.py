"""Naive Bayes that predicts each training sequence before it learns it, in the order of the sequences.

A learner that goes through the sequences one by one has, at each, the counts of those before. Here they are sums over earlier
positions: of a phrase in each class, of all phrases, of the sequences and of the phrases that are new. Each is made in ranges of
positions with the totals of earlier ranges carried (`running`), so neither a phrase that all sequences have nor the whole order is one task.

The Bernoulli form also counts what a sequence doesn't have: the sum of ln(sequences of the class - those with the phrase + smoothing)
over the whole vocabulary, at each position. Phrases of one count weigh the same, so it is a sum over the histogram of counts. A range
of positions starts with the histogram that the ranges before have made, and follows the changes of its own sequences.

Before both classes have been seen there is nothing to compare: the score is the share of the class that has been, 0.5 at the first.
Ties of the order aren't defined, as window_id is unique. A model of all training is what `bayes` fits; the two agree, which is tested.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.bayes import BERNOULLI, COMPLEMENT, MULTINOMIAL
from seqloom.operators.labels import is_anomalous
from seqloom.operators.running import sums_before
from seqloom.schemas import TRAIN
from seqloom.storage import kept

#: Sequences whose sums are made in one task.
CHUNK = 100_000


@dataclass(frozen=True)
class OnlineNaiveBayes:
    form: str = MULTINOMIAL
    smoothing: float = 1.0
    threshold: float = 0.5
    chunk: int = CHUNK

    def progressive(self, features: DataFrame, sequences: DataFrame) -> DataFrame:
        """window_id, label, score (posterior of anomalous by what was learnt before) and predicted_label of the training sequences. features: window_id, feature, cnt."""
        train = sequences.where(F.col("split_label") == TRAIN).select("window_id", is_anomalous(F.col("label")).cast("int").alias("label"))
        one = F.lit(1).cast("long") if self.form == BERNOULLI else F.col("cnt").cast("long")
        split = {f"v{c}": F.when(F.col("label") == c, one).otherwise(0) for c in (0, 1)}
        rows = kept(features.join(train, "window_id").select("window_id", "label", "feature", one.alias("x"), *(v.alias(k) for k, v in split.items())))
        known = kept(sums_before(rows, ["feature"], "window_id", {"c0": "v0", "c1": "v1"}, self.chunk))
        # what each sequence adds: itself, its phrases, and those that nobody had before
        added = known.groupBy("window_id").agg(F.sum("v0").alias("p0"), F.sum("v1").alias("p1"), F.count_if((F.col("c0") == 0) & (F.col("c1") == 0)).alias("new"))
        steps = train.join(added, "window_id", "left").select("window_id", "label", F.lit(1).cast("long").alias("one"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("p0", "p1", "new")))
        steps = steps.withColumns({f"s{c}": F.when(F.col("label") == c, 1).otherwise(0).cast("long") for c in (0, 1)})
        state = kept(sums_before(steps, [], "window_id", {"n0": "s0", "n1": "s1", "t0": "p0", "t1": "p1", "vocabulary": "new"}, self.chunk))
        score = self.log_odds(known, state)
        return score.select("window_id", "label", "score", (F.round("score", 10) >= self.threshold).cast("int").alias("predicted_label"))

    def log_odds(self, known: DataFrame, state: DataFrame) -> DataFrame:
        a = self.smoothing
        rows = known.select("window_id", "feature", "x", "c0", "c1").join(state.select("window_id", "n0", "n1", "t0", "t1", "vocabulary"), "window_id")
        if self.form == BERNOULLI:
            rows = rows.where((F.col("c0") > 0) | (F.col("c1") > 0))
            # a phrase that is there, less its absence, which is in the sum over the vocabulary
            own = {c: F.log(F.col(f"c{c}") + a) - F.log(F.col(f"n{c}") - F.col(f"c{c}") + a) for c in (0, 1)}
        else:
            size = F.greatest("vocabulary", F.lit(1))
            p = {c: F.col("x") * F.log((F.col(f"c{c}") + a) / (F.col(f"t{c}") + a * size)) for c in (0, 1)}
            own = {0: -p[1], 1: -p[0]} if self.form == COMPLEMENT else p
        sums = rows.groupBy("window_id").agg(*(F.sum(v).alias(f"l{c}") for c, v in own.items()))
        out = state.join(sums, "window_id", "left")
        total = {c: F.coalesce(f"l{c}", F.lit(0.0)) for c in (0, 1)}
        if self.form == BERNOULLI:
            out = out.join(self.absences(known, state), "window_id")
            total = {c: total[c] + F.col(f"g{c}") - F.col("vocabulary") * F.log(F.col(f"n{c}") + 2 * a) for c in (0, 1)}
        if self.form != COMPLEMENT:
            total = {c: total[c] + F.log(F.col(f"n{c}").cast("double")) for c in (0, 1)}
        both = (F.col("n0") > 0) & (F.col("n1") > 0)
        top = F.greatest(total[0], total[1])
        posterior = F.exp(total[1] - top) / (F.exp(total[0] - top) + F.exp(total[1] - top))
        early = F.when(F.col("n1") > 0, 1.0).when(F.col("n0") > 0, 0.0).otherwise(0.5)
        return out.withColumn("score", F.when(both, posterior).otherwise(early))

    def absences(self, known: DataFrame, state: DataFrame) -> DataFrame:
        """window_id, g0 and g1: the sum of ln(n - c + smoothing) over the phrases known before, for each class."""
        new = (F.col("c0") == 0) & (F.col("c1") == 0)
        step = lambda j, by: F.struct(j.cast("long").alias("j"), F.lit(by).cast("long").alias("by"))

        def changes(c: int) -> Column:
            own = F.col("label") == c
            mine, after = F.col(f"c{c}"), F.col(f"c{c}") + F.when(own, 1).otherwise(0)
            return F.when(new, F.array(step(after, 1))).when(own, F.array(step(mine, -1), step(after, 1))).otherwise(F.array().cast("array<struct<j:bigint,by:bigint>>"))

        sides = [known.select("window_id", F.lit(c).alias("class"), F.explode(changes(c)).alias("s")) for c in (0, 1)]
        at = F.floor(F.col("window_id") / F.lit(self.chunk)).alias("range")
        moved = sides[0].unionByName(sides[1]).groupBy(at, "class", "window_id", "s.j").agg(F.sum("s.by").alias("by")).where("by <> 0")
        moved = kept(moved)
        # the histogram that a range starts with: each count's phrases stay as they are until the next range that changes them
        ranges = kept(state.select(at).distinct())
        last = ranges.agg(F.max("range").alias("last"))  # one row
        per = Window.partitionBy("class", "j").orderBy("range")
        held = moved.groupBy("class", "j", "range").agg(F.sum("by").alias("by"))
        held = held.withColumn("held", F.sum("by").over(per.rowsBetween(Window.unboundedPreceding, 0))).withColumn("until", F.lead("range").over(per)).join(F.broadcast(last))
        upto = F.coalesce("until", "last")
        starts = held.where((F.col("held") != 0) & (F.col("range") < upto)).select("class", "j", "held", F.explode(F.sequence(F.col("range") + 1, upto)).alias("range")).join(ranges, "range")
        empty = F.lit(None).cast("long")
        asked = state.select(at, "window_id", F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"n{c}").alias("n")) for c in (0, 1)))).alias("q"))
        rows = asked.select("range", "q.class", "window_id", empty.alias("j"), empty.alias("by"), "q.n")
        rows = rows.unionByName(moved.select("range", "class", "window_id", "j", "by", empty.alias("n")))
        rows = rows.unionByName(starts.select("range", "class", F.lit(-1).cast("long").alias("window_id"), "j", F.col("held").alias("by"), empty.alias("n")))
        # a range starts with its histogram; a sequence is asked for before it is learnt
        dealt = rows.repartition("range", "class").sortWithinPartitions("range", "class", "window_id", F.col("j").asc_nulls_first())
        found = dealt.mapInArrow(following(self.smoothing), "window_id long, class int, g double")
        return found.groupBy("window_id").agg(*(F.max(F.when(F.col("class") == c, F.col("g"))).alias(f"g{c}") for c in (0, 1)))


class Histogram:
    """How many phrases have each count. Counts lie in arrays, so that a sum over all of them is one array expression."""

    def __init__(self):
        self.place, self.free = {}, []
        self.counts, self.times, self.used = np.zeros(64), np.zeros(64), 0

    def add(self, count: int, by: int) -> None:
        if (k := self.place.get(count)) is None:
            if self.free:
                k = self.free.pop()
            else:
                if self.used == len(self.counts):
                    self.counts, self.times = (np.concatenate([x, np.zeros(len(x))]) for x in (self.counts, self.times))
                k, self.used = self.used, self.used + 1
            self.place[count], self.counts[k] = k, count
        self.times[k] += by
        if not self.times[k]:
            # the count of a free place stays below those of the class, so its logarithm is a number
            del self.place[count]
            self.free.append(k)

    def absence(self, n: int, smoothing: float) -> float:
        """The sum of ln(n - count + smoothing) over all phrases, exactly rounded."""
        return math.fsum((self.times[: self.used] * np.log(n - self.counts[: self.used] + smoothing)).tolist())


def following(smoothing: float):
    """Goes through ranges of histogram changes and gives the sums that their sequences ask for."""

    def run(batches):
        import pyarrow as pa

        last, histogram = None, Histogram()
        for batch in batches:
            out = []
            for at, own, window, j, by, n in zip(*(batch.column(c).to_pylist() for c in ("range", "class", "window_id", "j", "by", "n"))):
                if (at, own) != last:
                    last, histogram = (at, own), Histogram()
                if n is None:
                    histogram.add(j, by)
                else:
                    out.append((window, own, histogram.absence(n, smoothing)))
            columns = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["window_id", "class", "g"])

    return run
