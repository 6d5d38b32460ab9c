"""What detectors see of a sequence: its templates in order, their counts, counts of phrases, or features of one's own.

A representation of one's own gets a sequence as Arrow batches in the order of its events, and carries a state from one to the next, so a
sequence is never held whole, however long it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import normalised, phrases_of, tokens
from seqloom.operators.running import RANGE

#: Events whose phrases are counted in one task, and positions of a sequence that are.
ROWS = 50_000


def sequential(members: DataFrame) -> DataFrame:
    """window_id and templates in order."""
    rows = members.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("pos", "template"))).alias("i"))
    return rows.select("window_id", F.transform("i", lambda x: x["template"]).alias("templates"))


def template_counts(members: DataFrame) -> DataFrame:
    """window_id, feature and cnt: each template's events in each sequence."""
    return members.groupBy("window_id", F.col("template").alias("feature")).agg(F.count("*").alias("cnt"))


def phrase_counts(members: DataFrame, low: int = 1, high: int = 2, rows: int = ROWS) -> DataFrame:
    """window_id, feature and cnt: phrases of the templates. A template is cut into phrases once for each range of a sequence's positions.

    Ranges of `rows` positions are dealt to tasks of about `rows` events each, so a task holds no more phrases where the log is larger.
    """
    size = members.agg(F.count("*").alias("n"), F.max("pos").alias("last")).first()
    tasks = max(-(-size["n"] // rows), members.sparkSession.sparkContext.defaultParallelism)
    keys = ["window_id", RANGE]
    ranged = members.select("window_id", F.floor(F.col("pos") / F.lit(rows)).alias(RANGE), "template").repartition(tasks, *keys)
    counts = ranged.groupBy(*keys, "template").agg(F.count("*").alias("cnt")).withColumns({"_tokens": tokens(F.col("template")), "_whole": normalised(F.col("template"))})
    cut = counts.select(*keys, "cnt", F.explode(phrases_of(F.col("_whole"), F.col("_tokens"), low, high)).alias("feature"))
    found = cut.groupBy(*keys, "feature").agg(F.sum("cnt").alias("cnt"))
    if (size["last"] or 0) < rows:
        return found.drop(RANGE)
    return found.groupBy("window_id", "feature").agg(F.sum("cnt").alias("cnt"))


def labelled_examples(represented: DataFrame, sequences: DataFrame) -> DataFrame:
    """Each represented row with its sequence's label and split."""
    return represented.join(sequences.select("window_id", "label", "split_label"), "window_id")


class Representation(Protocol):
    """Features of sequences. columns: what it reads of members beside window_id and pos."""

    columns: tuple[str, ...]

    def start(self) -> Any:
        """The state before a sequence's first event."""

    def step(self, state: Any, events: pa.RecordBatch) -> Any:
        """The state after some further events (pos and the columns), in order."""

    def finish(self, state: Any) -> Iterable[tuple[str, int]]:
        """Features and their counts, once the sequence has ended."""


class Transitions:
    """How often a template comes right after another one: a feature of both names."""

    columns = ("template",)

    def start(self) -> tuple[str | None, Counter]:
        return None, Counter()

    def step(self, state, events):
        last, counts = state
        for template in events.column("template").to_pylist():
            if last is not None and template is not None:
                counts[f"{last} > {template}"] += 1
            last = template
        return last, counts

    def finish(self, state):
        return state[1].items()


#: Name -> representation; further ones are added by `register`.
REPRESENTATIONS: dict[str, Callable[[], Representation]] = {"transitions": Transitions}


def register(name: str, factory: Callable[[], Representation]) -> None:
    """Adds a representation of one's own under a new name."""
    if name in REPRESENTATIONS:
        raise ValueError(f"there is a representation {name!r} already")
    REPRESENTATIONS[name] = factory


def represented(members: DataFrame, representation: Representation | str) -> DataFrame:
    """window_id, feature and cnt, as template_counts gives them, by a representation or its registered name. Sequences are dealt to tasks and streamed through it."""
    if isinstance(representation, str):
        if representation not in REPRESENTATIONS:
            raise KeyError(f"unknown representation {representation!r}; known: {', '.join(sorted(REPRESENTATIONS))}")
        representation = REPRESENTATIONS[representation]()
    own = representation

    def run(batches):
        last, state = None, None

        def ended():
            rows = list(own.finish(state))
            return pa.RecordBatch.from_arrays([pa.array([last] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["window_id", "feature", "cnt"])

        for batch in batches:
            windows, at = batch.column("window_id").to_pylist(), 0
            while at < batch.num_rows:
                upto = next((k for k in range(at, batch.num_rows) if windows[k] != windows[at]), batch.num_rows)
                if windows[at] != last:
                    if last is not None:
                        yield ended()
                    last, state = windows[at], own.start()
                state = own.step(state, batch.slice(at, upto - at).select(["pos", *own.columns]))
                at = upto
        if last is not None:
            yield ended()

    rows = members.select("window_id", "pos", *own.columns).repartition("window_id").sortWithinPartitions("window_id", "pos")
    return rows.mapInArrow(run, "window_id long, feature string, cnt long")
