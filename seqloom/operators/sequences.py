"""Sequences of log rows: by entity, in windows of a fixed number of rows, and in windows of time.

Builders give two frames. `members` has one row per event of each sequence (window_id, pos and the row's
columns); `sequences` has one row per sequence with its label and split. Both are written once when they are built, so what
is learnt from them doesn't build them again. Arrays are made only at the edge
(`nested`), so one entity with a third of all rows stays many rows.

Splits are by position: the last ceil(test * n) sequences are test, the first ceil(train * n) of the others
train, what is between is ignored. For windows n is an estimate from the number of rows or the time
span that can differ from the number of windows that come out; later windows are then test.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.labels import is_anomalous
from seqloom.operators.ordinals import CHUNK, nth_position, ordinals, positions_within
from seqloom.operators.running import last_before
from seqloom.schemas import IGNORED, TEST, TRAIN
from seqloom.storage import kept


@dataclass(frozen=True)
class SplitCounts:
    total: int
    train: int
    ignored: int
    test: int


def validate_fractions(train: float, test: float) -> None:
    for name, value in (("train", train), ("test", test)):
        if not 0 <= value <= 1:
            raise ValueError(f"{name} fraction must be between 0 and 1: {value}")
    if train + test > 1:
        raise ValueError(f"train and test fractions add up to more than 1: {train} + {test}")


def split_counts(total: int, train: float, test: float) -> SplitCounts:
    """Sizes of the split parts; ceilings of IEEE doubles, as Python makes them."""
    if total <= 0:
        return SplitCounts(0, 0, 0, 0)
    n_test = min(total, math.ceil(test * total))
    n_train = min(total - n_test, math.ceil(train * total))
    return SplitCounts(total, n_train, total - n_train - n_test, n_test)


def counted_fixed_windows(rows: int, size: int, step: int | None) -> int:
    """The estimate that splits of fixed windows are made from."""
    if rows <= 0:
        return 0
    return 1 if rows <= size else 1 + math.ceil((rows - size) / (step or size))


def counted_time_windows(first: int | None, last: int | None, span: int, step: int | None) -> int:
    """The estimate that splits of time windows are made from."""
    if first is None or last is None:
        return 0
    return 1 if last - first < span else (last - first - span) // (step or span) + 1


@dataclass(frozen=True)
class Sequences:
    """What a builder gives: members in long form, one row per sequence, and the counts its split is made from."""

    members: DataFrame
    sequences: DataFrame
    counts: SplitCounts


@dataclass(frozen=True)
class SequenceBuilder:
    """rows: structured rows with a template column (and params where there are any); group_labels: entity_id, label."""

    rows: DataFrame
    group_labels: DataFrame
    train_fraction: float = 0.2
    test_fraction: float = 0.8
    exact_split: bool = False
    chunk: int = CHUNK

    def with_split_fractions(self, train: float, test: float) -> SequenceBuilder:
        validate_fractions(train, test)
        return replace(self, train_fraction=train, test_fraction=test)

    def labelled(self) -> DataFrame:
        """rows with group_label. The label table is as large as there are labelled entities: Spark chooses the join."""
        return self.rows.join(self.group_labels.select("entity_id", F.col("label").alias("group_label")), "entity_id", "left")

    def by_position(self, sequences: DataFrame, counts: SplitCounts) -> DataFrame:
        split = F.when(F.col("window_id") >= counts.total - counts.test, TEST).when(F.col("window_id") < counts.train, TRAIN).otherwise(IGNORED)
        return sequences.withColumn("split_label", split)

    def summarised(self, members: DataFrame) -> DataFrame:
        """A row per sequence: label (any anomalous row or group), events, first and last line, and the largest group label."""
        flag = is_anomalous(F.col("anomalous")) | is_anomalous(F.col("group_label"))
        return members.groupBy("window_id").agg(F.max(flag.cast("int")).alias("label"), F.count("*").alias("event_count"), F.min("line_order").alias("first_line"), F.max("line_order").alias("last_line"), F.max("group_label").alias("group_label"))


@dataclass(frozen=True)
class EntitySequences(SequenceBuilder):
    """One sequence per entity, in the order of the entities' first rows."""

    train_on_normal_entities_only: bool = False

    def chronology(self) -> DataFrame:
        """entity_id and window_id: by time of the entity's first row in the file (missing last), its line, its name."""
        known = self.rows.where("entity_id IS NOT NULL")
        first = known.groupBy("entity_id").agg(F.min(F.struct("line_order", "timestamp_unix_ms")).alias("first"))
        keys = first.select("entity_id", F.col("first.timestamp_unix_ms").alias("first_ts"), F.col("first.line_order").alias("first_line"))
        return ordinals(keys, [F.col("first_ts").asc_nulls_last(), F.col("first_line"), F.col("entity_id")], "window_id")

    def build(self) -> Sequences:
        order = self.chronology().select("entity_id", "window_id")
        lines = self.rows.agg((F.max("line_order") - F.min("line_order") + 1).alias("n")).first()["n"] or 0
        members = kept(positions_within(self.labelled().join(order, "entity_id"), "window_id", "line_order", lines, self.chunk))
        entities = kept(self.summarised(members))
        counts = split_counts(entities.count(), self.train_fraction, self.test_fraction)
        if not self.train_on_normal_entities_only:
            return Sequences(members, self.by_position(entities, counts).drop("group_label"), counts)
        pool = F.col("window_id") < counts.total - counts.test
        may = pool & ~is_anomalous(F.col("group_label"))
        # training ends with the sequence that is the last one of the normal ones that it may have
        last = nth_position(entities.where(may & (F.col("label") == 0)), "window_id", counts.train - 1, counts.total) if counts.train else -1
        within = F.lit(True) if last is None else F.col("window_id") <= last
        split = F.when(~pool, TEST).when(may & within, TRAIN).otherwise(IGNORED)
        return Sequences(members, entities.withColumn("split_label", split).drop("group_label"), counts)


@dataclass(frozen=True)
class FixedWindows(SequenceBuilder):
    """Windows of `size` rows in line order, one every `step` rows (never skipping rows: a larger step counts as size)."""

    size: int = 1
    step: int | None = None

    def __post_init__(self):
        if self.size <= 0 or (self.step is not None and self.step <= 0):
            raise ValueError("window size and step must be positive")

    def build(self) -> Sequences:
        n, w = self.rows.count(), self.size
        e = min(self.step or w, w)
        full = 0 if n < w else (n - w) // e + 1
        last = full if full * e < n else full - 1
        numbered = ordinals(self.labelled(), [F.col("line_order")], "_rn")
        low = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_rn") - (w - 1)) / F.lit(e)).cast("long"))
        high = F.least(F.floor(F.col("_rn") / F.lit(e)).cast("long"), F.lit(last).cast("long"))
        # sequence() counts down where its end is smaller
        windows = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        members = kept(numbered.withColumn("window_id", F.explode(windows)).withColumn("pos", (F.col("_rn") - F.col("window_id") * e)).drop("_rn"))
        total = last + 1 if self.exact_split else counted_fixed_windows(n, w, self.step)
        counts = split_counts(total, self.train_fraction, self.test_fraction)
        return Sequences(members, self.by_position(kept(self.summarised(members)), counts).drop("group_label"), counts)


@dataclass(frozen=True)
class TimeWindows(SequenceBuilder):
    """Windows of `span` ms from the first timestamp on, one every `step` ms; empty ones are skipped, rows without time too.

    With a step beyond the span, rows in a gap fall into the next window.
    """

    span: int = 1
    step: int | None = None

    def __post_init__(self):
        if self.span <= 0 or (self.step is not None and self.step <= 0):
            raise ValueError("time span and step must be positive")

    def build(self) -> Sequences:
        bounds = self.rows.agg(F.min("timestamp_unix_ms").alias("a"), F.max("timestamp_unix_ms").alias("b")).first()
        first, last, span, step = bounds["a"], bounds["b"], self.span, self.step or self.span
        if first is None:
            raise ValueError("no row has a timestamp")
        # in time order each window is a run of rows: a row's place in it is its position less that of the window's first row
        timed = ordinals(self.labelled().where("timestamp_unix_ms IS NOT NULL"), [F.col("timestamp_unix_ms"), F.col("line_order")], "_rn")
        past = F.col("timestamp_unix_ms") - first
        low = F.greatest(F.lit(0).cast("long"), F.floor((past - span) / F.lit(step)).cast("long") + 1)
        high = F.floor(past / F.lit(step)).cast("long") if step <= span else low
        members = timed.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))).where(F.lit(first) + F.col("_k") * step <= last)
        windows = members.groupBy("_k").agg(F.min("_rn").alias("_first"))
        # a window's number: its place among those that have rows
        if (last - first) // step < self.chunk:
            windows = kept(windows.withColumn("window_id", (F.row_number().over(Window.orderBy("_k")) - 1).cast("long")))
        else:
            windows = ordinals(windows, [F.col("_k")], "window_id")
        members = kept(members.join(windows, "_k").withColumn("pos", F.col("_rn") - F.col("_first")).drop("_k", "_rn", "_first"))
        total = windows.count() if self.exact_split else counted_time_windows(first, last, span, self.step)
        counts = split_counts(total, self.train_fraction, self.test_fraction)
        return Sequences(members, self.by_position(kept(self.summarised(members)), counts).drop("group_label"), counts)


def with_time_gaps(members: DataFrame, name: str = "dt_prev_ms", chunk: int = CHUNK) -> DataFrame:
    """members with the milliseconds since the last event of the sequence that has a time; null where there is none. A long sequence is looked at in ranges of `chunk` positions."""
    rows = last_before(members, ["window_id"], "pos", "timestamp_unix_ms", "_before", chunk)
    return rows.withColumn(name, F.col("timestamp_unix_ms") - F.col("_before")).drop("_before")


def entity_ids(members: DataFrame) -> DataFrame:
    """window_id and entity_ids, the sequence's different entities in the order of first sight. Events are counted down to one row for each entity before any are put together."""
    first = members.where("entity_id IS NOT NULL").groupBy("window_id", "entity_id").agg(F.min("pos").alias("pos"))
    ids = first.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))).alias("i"))
    return ids.select("window_id", F.transform("i", lambda x: x["entity_id"]).alias("entity_ids"))


def nested(built: Sequences) -> DataFrame:
    """Sequences with their events, entity ids (in the order of first sight) and event labels as arrays."""
    members = built.members
    params = F.col("params") if "params" in members.columns else F.array().cast("array<string>")
    rows = with_time_gaps(members).withColumn("_params", params)
    item = F.struct("pos", F.struct(F.col("template"), F.col("_params").alias("params"), F.col("dt_prev_ms")).alias("event"), "entity_id", "anomalous")
    grouped = rows.groupBy("window_id").agg(F.array_sort(F.collect_list(item)).alias("i"), F.count("anomalous").alias("marked"))
    ids = F.array_distinct(F.filter(F.transform("i", lambda x: x["entity_id"]), lambda e: e.isNotNull()))
    marks = F.when(F.col("marked") > 0, F.transform("i", lambda x: x["anomalous"]))
    arrays = grouped.select("window_id", F.transform("i", lambda x: x["event"]).alias("events"), ids.alias("entity_ids"), marks.alias("event_labels"))
    return built.sequences.select("window_id", "label", "split_label").join(arrays, "window_id")


def sole_entity_id() -> Column:
    return F.when(F.size("entity_ids") == 1, F.col("entity_ids")[0])


def split_summary(built: Sequences, builder: SequenceBuilder) -> DataFrame:
    """One row: requested fractions, and what came of them."""
    count = lambda split: F.count_if(F.col("split_label") == split)
    s = built.sequences.agg(
        F.count("*").alias("n"),
        count(TRAIN).alias("train"),
        count(IGNORED).alias("ignored"),
        count(TEST).alias("test"),
        F.count_if((F.col("split_label") == IGNORED) & is_anomalous(F.col("label"))).alias("bad_ignored"),
        F.count_if((F.col("split_label") != TEST) & ~is_anomalous(F.col("label"))).alias("good_pool"),
    )
    entity = isinstance(builder, EntitySequences)
    normal_only = entity and builder.train_on_normal_entities_only
    if normal_only:
        eligible = F.col("good_pool")
    elif entity or builder.test_fraction:
        eligible = F.col("n") - F.col("test")
    else:
        eligible = F.col("n")
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 8)
    return s.select(
        F.lit(builder.train_fraction).alias("requested_train_fraction"),
        F.lit(builder.test_fraction).alias("requested_test_fraction"),
        F.lit(normal_only if entity else None).cast("boolean").alias("train_on_normal_entities_only"),
        (F.col("train") + F.col("ignored")).alias("train_pool_sequence_count"),
        (F.col("bad_ignored") if normal_only else F.lit(0).cast("long")).alias("ineligible_train_pool_count"),
        F.col("train").alias("realised_train_sequence_count"),
        F.col("ignored").alias("excluded_from_train_count"),
        eligible.alias("eligible_train_sequence_count"),
        F.col("ignored").alias("ignored_sequence_count"),
        ratio(F.col("train"), eligible).alias("effective_train_fraction_of_eligible"),
        ratio(F.col("train"), F.col("n")).alias("effective_train_fraction_overall"),
    )
