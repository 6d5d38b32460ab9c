"""Windows, splits and sequences against small fixtures and a plain buffer simulation."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.operators.sequences import EntitySequences, FixedWindows, TimeWindows, counted_fixed_windows, nested, sole_entity_id, split_counts, split_summary, validate_fractions

COLUMNS = "line_order long, timestamp_unix_ms long, entity_id string, template string, anomalous long"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def labels(spark, pairs=()):
    return spark.createDataFrame(list(pairs), "entity_id string, label long")


def windows(built, column="line_order"):
    rows = built.members.orderBy("window_id", "pos").collect()
    out = {}
    for r in rows:
        out.setdefault(r["window_id"], []).append(r[column])
    return [out[k] for k in sorted(out)]


def splits(built):
    return [r["split_label"] for r in built.sequences.orderBy("window_id").collect()]


def test_time_windows_overlap(spark):
    rows = frame(spark, [(0, 0, "a", "t", 0), (1, 5, "c", "t", 0), (2, 12, "b", "t", 0), (3, 18, "a", "t", 0)])
    assert windows(TimeWindows(rows, labels(spark), span=10, step=5).build(), "timestamp_unix_ms") == [[0, 5], [5, 12], [12, 18], [18]]


def test_time_windows_skip_rows_without_time(spark):
    rows = frame(spark, [(0, 100, "a", "t", 0), (1, 110, None, "t", 0), (2, None, "a", "t", 0), (3, 140, "a", "t", 0)])
    built = TimeWindows(rows, labels(spark), span=15, step=15).build()
    assert windows(built, "timestamp_unix_ms") == [[100, 110], [140]]


def test_time_windows_need_a_time(spark):
    with pytest.raises(ValueError):
        TimeWindows(frame(spark, [(0, None, "a", "t", 0)]), labels(spark), span=5).build()
    with pytest.raises(ValueError):
        TimeWindows(frame(spark, []), labels(spark), span=0)


def test_fixed_windows_never_skip_rows(spark):
    rows = frame(spark, [(i, i, "a", "t", 0) for i in range(3)])
    assert windows(FixedWindows(rows, labels(spark), size=2, step=3).build()) == [[0, 1], [2]]
    with pytest.raises(ValueError):
        FixedWindows(rows, labels(spark), size=0)


@pytest.mark.parametrize("size,step,fractions,expected", [(3, 2, (0.34, 0.25), ["train", "train", "ignored", "test"]), (4, 2, (0.67, 0.25), ["train", "train", "test", "test"])])
def test_fixed_window_splits_follow_the_estimate(spark, size, step, fractions, expected):
    rows = frame(spark, [(i, i, "a", "t", 0) for i in range(8)])
    builder = FixedWindows(rows, labels(spark), *fractions, size=size, step=step)
    assert splits(builder.build()) == expected


def test_normal_only_training_ignores_anomalous_entities(spark):
    names = "abcdefghij"
    rows = frame(spark, [(i, 100 * (i + 1), e, "t", 1 if e == "a" else 0) for i, e in enumerate(names)])
    builder = EntitySequences(rows, labels(spark, [("a", 1)]), 0.2, 0.8, train_on_normal_entities_only=True)
    built = builder.build()
    assert splits(built) == ["ignored", "train"] + ["test"] * 8
    row = split_summary(built, builder).first()
    assert (row["effective_train_fraction_of_eligible"], row["effective_train_fraction_overall"], row["ineligible_train_pool_count"]) == (1.0, 0.1, 1)


def test_entities_stand_in_the_order_of_their_first_rows(spark):
    rows = frame(spark, [(0, 300, "m", "t", 0), (1, 100, "z", "t", 0), (2, 400, "a", "t", 0), (3, 200, "b", "t", 0), (4, None, "n", "t", 0), (5, 1, "n", "t", 0), (6, 7, None, "t", 0)])
    order = EntitySequences(rows, labels(spark)).chronology().orderBy("window_id").collect()
    assert [r["entity_id"] for r in order] == ["z", "b", "m", "a", "n"]


def test_group_label_two_is_anomalous(spark):
    rows = frame(spark, [(0, 1, "a", "t", None), (1, 2, "b", "t", None)])
    built = EntitySequences(rows, labels(spark, [("b", 2)]), 0.5, 0.2).build()
    assert splits(built) == ["train", "test"]
    assert [r["label"] for r in built.sequences.orderBy("window_id").collect()] == [0, 1]


def test_nested_sequences(spark):
    rows = frame(spark, [(0, 100, "a", "one", None), (1, 130, "a", "two", 0), (2, 170, "c", "three", None)])
    out = nested(FixedWindows(rows, labels(spark), 0.5, 0.5, size=2, step=2).build()).withColumn("sole", sole_entity_id()).orderBy("window_id").collect()
    assert [[(e["template"], e["dt_prev_ms"]) for e in r["events"]] for r in out] == [[("one", None), ("two", 30)], [("three", None)]]
    assert [r["event_labels"] for r in out] == [[None, 0], None]
    assert [(r["entity_ids"], r["sole"]) for r in out] == [(["a"], "a"), (["c"], "c")]


def test_gap_is_to_the_last_known_time(spark):
    rows = frame(spark, [(0, 100, "a", "t", 0), (1, None, "a", "t", 0), (2, 250, "a", "t", 0)])
    out = nested(EntitySequences(rows, labels(spark)).build()).first()
    assert [e["dt_prev_ms"] for e in out["events"]] == [None, None, 150]


def test_split_counts_use_double_ceilings():
    c = split_counts(100, 0.07, 0.5)
    assert (c.train, c.ignored, c.test) == (8, 42, 50)
    assert split_counts(0, 0.5, 0.5).total == 0
    for bad in ((-0.1, 0.5), (0.6, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError):
            validate_fractions(*bad)
    assert counted_fixed_windows(8, 4, 2) == 3


def simulated_fixed(n, size, step):
    """A buffer of rows: emitted when full, advanced by the smaller of step and size, its rest emitted at the end."""
    out, buffer = [], []
    for i in range(n):
        buffer.append(i)
        if len(buffer) == size:
            out.append(list(buffer))
            buffer = buffer[min(step, size) :]
    if buffer and (not out or buffer[-1] > out[-1][-1] or min(step, size) * len(out) < n):
        out.append(buffer)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 25), st.integers(1, 8), st.integers(1, 10))
def test_fixed_windows_match_a_buffer(spark, n, size, step):
    rows = frame(spark, [(i, i, "a", "t", 0) for i in range(n)])
    e = min(step, size)
    expected = [list(range(k * e, min(n, k * e + size))) for k in range(math.ceil(n / e)) if k == 0 or (k - 1) * e + size < n or k * e < n]
    full = 0 if n < size else (n - size) // e + 1
    expected = expected[: full + (full * e < n)]
    got = windows(FixedWindows(rows, labels(spark), size=size, step=step).build())
    assert got == expected == simulated_fixed(n, size, step)


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    from seqloom.queries import QUERIES

    seen = []
    for n in (1, 4, 17):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, QUERIES["entity_sequences_normal_only"](spark, sf_dir).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]


def test_ordinals_of_ties_and_many_rows(spark):
    from seqloom.operators.ordinals import ordinals

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id"))
    out = ordinals(rows, [F.col("k"), F.col("id")], "n").orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(1000))
    assert [(r["k"], r["id"]) for r in out] == sorted((i % 7, i) for i in range(1000))


def test_ordinals_without_times(spark):
    """All ties in the first column, and many more ranges than rows: entities without a time."""
    from seqloom.operators.ordinals import ordinals

    rows = spark.range(500).select(F.lit(None).cast("long").alias("ts"), (F.lit(999) - F.col("id")).alias("line"))
    out = ordinals(rows, [F.col("ts").asc_nulls_last(), F.col("line")], "n").orderBy("n").collect()
    assert [(r["n"], r["line"]) for r in out] == [(i, 500 + i) for i in range(500)]
    assert ordinals(rows.limit(0), [F.col("line")], "n").isEmpty()


def test_positions_in_chunks(spark):
    """One group holds a third of all rows; its rows are numbered in many ranges."""
    from seqloom.operators.ordinals import positions_within

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"), (F.col("id") * 7 % 3001).alias("line"))
    whole = sorted(map(tuple, positions_within(rows, "g", "line", 3001).collect()))
    assert sorted(map(tuple, positions_within(rows, "g", "line", 3001, 100).collect())) == whole
    assert max(r[2] for r in whole if r[0] == "hot") == 999


def test_nth_position(spark):
    from seqloom.operators.ordinals import nth_position

    kept = [i for i in range(500) if i % 7 == 3]
    frame = spark.createDataFrame([(i,) for i in kept], "i long")
    for n in (0, 1, 30, len(kept) - 1):
        assert nth_position(frame, "i", n, 500, pieces=4) == kept[n]
    assert nth_position(frame, "i", len(kept), 500) is None and nth_position(frame.limit(0), "i", 0, 0) is None
