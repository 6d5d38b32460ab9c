"""Detectors and metrics on small fixtures."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from seqloom.operators.bayes import NaiveBayes
from seqloom.operators.clusters import ClusteredContexts, common_places
from seqloom.operators.contexts import NO_EVENT, ContextModel, contexts, next_candidates, reason, top_templates
from seqloom.operators.frequency import TemplateFrequency, nearest_rank
from seqloom.operators.metrics import decision_summary, next_event_metrics, run_metrics
from seqloom.operators.next_event import KeyModel, ParameterModel, history_pairs, masked_mse, normalisation, parameter_schema, parameter_values, predict_jointly, tail_size
from seqloom.operators.online_bayes import Histogram, OnlineNaiveBayes
from seqloom.operators.representations import labelled_examples, phrase_counts, sequential, template_counts
from seqloom.operators.running import items_before, sums_before
from seqloom.operators.sequences import with_time_gaps

MEMBERS = "window_id long, pos int, template string, params array<string>, timestamp_unix_ms long, anomalous long"


def built(spark, sequences):
    """(templates, label, split) of each sequence."""
    members = [(i, p, t, [], 1000 * p, None) for i, (ts, _, _) in enumerate(sequences) for p, t in enumerate(ts)]
    rows = [(i, label, split, len(ts)) for i, (ts, label, split) in enumerate(sequences)]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame(rows, "window_id long, label int, split_label string, event_count long")


def test_metrics(spark):
    rows = [("test", 1, 1, 0.9, False), ("test", 0, 1, 0.8, False), ("test", 0, 0, 0.1, False), ("test", 1, 0, 0.2, False), ("test", 1, 0, 0.0, True), ("train", 1, 1, 1.0, False)]
    m = run_metrics(spark.createDataFrame(rows, "split_label string, label int, predicted_label int, score double, abstained boolean")).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"], m["abstained"]) == (1, 1, 1, 1, 1)
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"], m["mean_score"]) == (0.5, 0.5, 0.5, 0.5, 0.4)
    empty = run_metrics(spark.createDataFrame([], "split_label string, label int, predicted_label int, score double")).first()
    assert empty["f1"] == 0 and empty["mean_score"] == 0


def test_next_event_metrics(spark):
    rows = spark.createDataFrame([("A", ["A", "B"], ["A"]), ("A", ["B", "A"], ["A"]), ("B", ["B", "C"], ["A"])], "actual string, candidates array<string>, history array<string>")
    out = next_event_metrics(rows)
    assert [out["topk"].first()[f"hit_{k}"] for k in (1, 2, 5)] == [2, 3, 3]
    s = out["summary"].first()
    assert [round(s[f"macro_{x}"], 6) for x in ("precision", "recall", "f1")] == [0.75, 0.75, round(2 / 3, 6)]
    assert [round(s[f"weighted_{x}"], 6) for x in ("precision", "recall", "f1")] == [round(5 / 6, 6), round(2 / 3, 6), round(2 / 3, 6)]
    known = spark.createDataFrame([("A",)], "template string")
    two = spark.createDataFrame([("Z", ["A"], ["A"]), ("A", [], ["Q"])], "actual string, candidates array<string>, history array<string>")
    s = next_event_metrics(two, known=known, policy="train_only", insufficient=3)["summary"].first()
    assert (s["events"], s["eligible"], s["insufficient_history"], s["coverage"]) == (5, 0, 3, 0)
    s = next_event_metrics(two, known=known, policy="train_only")["summary"].first()
    assert (s["events"], s["eligible"], s["unknown_target"], s["unknown_history"]) == (2, 0, 1, 1)
    # all events count by default: one whose history is unknown is a miss
    whole = next_event_metrics(two, known=known)
    assert whole["topk"].first()["eligible"] == 2 and whole["topk"].first()["hit_5"] == 0
    assert (whole["summary"].first()["events"], whole["summary"].first()["unknown_history"], whole["summary"].first()["coverage"]) == (2, 0, 1)
    # a place without an event is an unknown history, whatever training has seen
    padded = spark.createDataFrame([("A", ["A"], [NO_EVENT, "A"]), ("A", ["A"], ["A", "A"])], "actual string, candidates array<string>, history array<string>")
    seen = spark.createDataFrame([("A",), (NO_EVENT,)], "template string")
    s = next_event_metrics(padded, known=seen, policy="train_only", padding=NO_EVENT)["summary"].first()
    assert (s["eligible"], s["unknown_history"]) == (1, 1)
    with pytest.raises(ValueError, match="policy"):
        next_event_metrics(two, policy="some")
    with pytest.raises(ValueError, match="known"):
        next_event_metrics(two, policy="train_only")


def test_top_templates_of_contexts(spark):
    rows = [("x", "A"), ("x", "B"), ("x", "B"), ("x", "C"), ("y", "C")]
    top = top_templates(spark.createDataFrame([([c], t) for c, t in rows], "context array<string>, template string").repartition(3), 2)
    assert sorted((r["context"][0], r["rank"], r["template"], r["n"]) for r in top.collect()) == [("x", 1, "B", 2), ("x", 2, "A", 1), ("y", 1, "C", 1)]
    asked = spark.createDataFrame([(["x"], "A"), (["z"], "C")], "context array<string>, template string")
    assert {r["actual"]: r["candidates"] for r in next_candidates(asked, top).collect()} == {"A": ["B", "A"], "C": []}


def test_template_frequency(spark):
    members, sequences = built(spark, [(["A", "A", "B"], 0, "train"), (["A", "Z"], 1, "test")])
    model = TemplateFrequency(threshold=0.3).fit(members, sequences)
    out = {r["window_id"]: r for r in model.predict(members, sequences).collect()}
    expected = (-math.log(3 / 5) - math.log(1 / 5)) / 2
    assert out[1]["score"] == pytest.approx(expected) and out[1]["predicted_label"] == 1
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 2, 4)], "v double")
    assert [nearest_rank(rows, "v", q) for q in (0.0, 0.25, 0.5, 0.76, 1.0)] == [1, 1, 2, 4, 4]
    assert nearest_rank(rows.limit(0), "v", 0.5) is None


def test_naive_bayes(spark):
    members, sequences = built(spark, [(["good day"], 0, "train"), (["bad night"], 1, "train"), (["bad day"], 1, "test")])
    features = phrase_counts(members)
    model = NaiveBayes(top_k=2).fit(features, sequences)
    out = model.predict(features, sequences).where("window_id = 2").first()

    def joint(own):
        counts = {"good day": 2, "good": 1, "day": 1} if own == 0 else {"bad night": 2, "bad": 1, "night": 1}
        return math.log(0.5) + sum(n * math.log((counts.get(p, 0) + 1) / (4 + 6)) for p, n in {"bad day": 2, "bad": 1, "day": 1}.items())

    a, b = joint(0), joint(1)
    assert out["score"] == pytest.approx(math.exp(b) / (math.exp(a) + math.exp(b)))
    keys = model.key_phrases(features, model.predict(features, sequences)).where("window_id = 1").orderBy("rank").collect()
    assert keys[0]["feature"] == "bad night"
    assert model.global_phrases(0).first()["feature"] == "good day"
    with pytest.raises(ValueError):
        NaiveBayes().fit(features, sequences.where("label = 0"))


def test_representations(spark):
    members, sequences = built(spark, [(["B", "A", "B"], 0, "train")])
    assert sequential(members).first()["templates"] == ["B", "A", "B"]
    assert {(r["feature"], r["cnt"]) for r in template_counts(members).collect()} == {("A", 1), ("B", 2)}
    assert labelled_examples(sequential(members), sequences).first()["label"] == 0


def test_phrases_are_counted_in_ranges(spark):
    long = ["good day"] * 25 + ["bad day"] * 20 + ["good day"] * 5
    members, _ = built(spark, [(long, 0, "train"), (["bad day"], 1, "train"), ([""], 1, "test"), *[(["a b", "b"], 0, "test")] * 200])
    expected = {(0, "good day"): 60, (0, "bad day"): 40, (0, "good"): 30, (0, "bad"): 20, (0, "day"): 50, (1, "bad day"): 2, (1, "bad"): 1, (1, "day"): 1}
    expected |= {(w, f): k for w in range(3, 203) for f, k in {"a b": 2, "a": 1, "b": 3}.items()}
    for rows in (7, 50, 1000):
        found = phrase_counts(members, rows=rows)
        assert {(r["window_id"], r["feature"]): r["cnt"] for r in found.collect()} == expected
    assert found.schema["cnt"].dataType == LongType() and found.columns == ["window_id", "feature", "cnt"]
    # a task gets so many events, however many there are
    assert phrase_counts(members, rows=60).rdd.getNumPartitions() == 8
    assert phrase_counts(members.limit(0)).count() == 0


def test_key_phrases_are_ranked_in_tasks_of_a_bounded_size(spark):
    rng = random.Random(4)
    bags = [([" ".join(rng.choices("abcdef", k=3)) for _ in range(rng.randint(1, 4))], k % 2, "train" if k < 20 else "test") for k in range(60)]
    members, sequences = built(spark, bags)
    features = phrase_counts(members)
    model = NaiveBayes(top_k=3).fit(features, sequences)
    predictions = model.predict(features, sequences)
    sign = {r["window_id"]: 1 if r["predicted_label"] == 1 else -1 for r in predictions.collect()}
    own = {}
    for r in model.weighted(features).collect():
        lean, n = round(r["cnt"] * (r["l"]["l1"] - r["l"]["l0"]) * sign[r["window_id"]], 10), len(r["feature"].split(" "))
        own.setdefault(r["window_id"], []).append((round(lean * n, 8), lean, n, r["feature"]))
    expected = set()
    for w, rows in own.items():
        rows = [r for r in rows if r[1] > 0] or rows
        expected |= {(w, k, r[3]) for k, r in enumerate(sorted(rows, reverse=True)[:3], 1)}
    for rows in (40, 10_000):
        found = model.key_phrases(features, predictions, rows)
        assert {(r["window_id"], r["rank"], r["feature"]) for r in found.collect()} == expected
    size = features.count()
    assert model.key_phrases(features, predictions, 40).rdd.getNumPartitions() == -(-size // 40) > 4


def test_histograms_of_counts(spark):
    rng, plain, histogram = random.Random(6), Counter(), Histogram()
    for _ in range(3000):
        j, by = rng.randint(0, 150), rng.choice([1, 1, 2])
        for count, times in ((j, by), (j, -plain[j]) if plain[j] and rng.random() < 0.4 else (j + 1, 1)):
            if times:
                plain[count] += times
                histogram.add(count, times)
        plain = +plain
    assert histogram.used < 160 and {c: histogram.times[k] for c, k in histogram.place.items()} == plain
    expected = math.fsum(times * math.log(500 - count + 0.5) for count, times in plain.items())
    assert histogram.absence(500, 0.5) == pytest.approx(expected, rel=1e-14)


def test_key_model(spark):
    members, sequences = built(spark, [(list("ABCABC"), 0, "train"), (list("ABCABX"), 1, "test"), (list("QBC"), 0, "test")])
    assert history_pairs(members, 2).where("window_id = 0").count() == 4
    out = {r["window_id"]: r for r in KeyModel(2, 1).fit(members, sequences).predict(members, sequences).collect()}
    assert (out[1]["predicted_label"], out[1]["score"]) == (1, 1.0)
    # an unknown history falls back to its ending
    assert out[2]["predicted_label"] == 0 and out[0]["predicted_label"] == 0


def test_unknown_histories(spark):
    members, sequences = built(spark, [(list("ABCABC"), 0, "train"), (list("QBCABC"), 0, "test"), (list("ABCA"), 0, "test")])
    model = KeyModel(2, 1, strict=True).fit(members, sequences)
    events = {r["pos"]: (r["anomalous"], r["p"], r["candidates"]) for r in model.events(members).where("window_id = 1").collect()}
    assert events[2] == (True, None, []) and not any(events[k][0] for k in (3, 4, 5))
    out = {r["window_id"]: (r["predicted_label"], r["score"]) for r in model.predict(members, sequences).collect()}
    assert out == {0: (0, 0.0), 1: (1, 1.0), 2: (0, 0.0)}


def test_keys_and_parameters(spark):
    # window 1 strays at an event whose key passed, window 2 at one whose key is anomalous (before an unknown template)
    value = lambda w, p: "50" if (w, p) in ((1, 8), (2, 8)) else "1"
    members = spark.createDataFrame([(w, p, "Q" if (w, p) == (2, 7) else "T", [value(w, p)], p * 10, None) for w in range(4) for p in range(9)], MEMBERS)
    sequences = spark.createDataFrame([(0, 0, "train"), (1, 0, "test"), (2, 0, "test"), (3, 0, "test")], "window_id long, label int, split_label string")
    keys, parameters = KeyModel(2, 1, strict=True).fit(members, sequences), ParameterModel().fit(members, sequences)
    out = {r["window_id"]: (r["predicted_label"], r["score"]) for r in predict_jointly(keys, parameters, members, sequences).collect()}
    margin = parameters.events(members).where("window_id = 1 AND pos = 8").first()["margin"]
    assert margin > 1 and out == {0: (0, 0.0), 1: (1, pytest.approx(margin)), 2: (1, 1.0), 3: (0, 0.0)}


def test_parameters(spark):
    rows = [(0, 0, "T", ["3.5", "nan-text", "7"], 0, None), (0, 1, "T", ["4.0", "5.0", "text"], 100, None)]
    values = parameter_values(spark.createDataFrame(rows, MEMBERS))
    schema = {r["feature"]: r["kept"] for r in parameter_schema(values).collect()}
    assert schema == {"dt_prev_ms": True, "param_0": True, "param_1": False, "param_2": False}
    row = spark.range(1).select(masked_mse(F.array(*map(F.lit, (7.0, 1000.0, 2.0))), F.array(*map(F.lit, (10.0, 0.0, 5.0))), F.array(*map(F.lit, (True, False, True)))))
    assert row.first()[0] == 9.0
    assert [tail_size(4, 0.5), tail_size(2, 0.01), tail_size(2, 1.0)] == [2, 1, 1]
    members = spark.createDataFrame([(w, p, "T", [str(50 if (w, p) == (1, 8) else p % 2)], p * 10, None) for w in (0, 1) for p in range(9)], MEMBERS)
    sequences = spark.createDataFrame([(0, 0, "train"), (1, 1, "test")], "window_id long, label int, split_label string")
    events = ParameterModel().fit(members, sequences).events(members)
    assert {(r["window_id"], r["pos"]) for r in events.where("anomalous AND margin > 1").collect()} == {(1, 8)}


def test_contexts(spark):
    members, sequences = built(spark, [(list("ABC"), 1, "train")])
    out = contexts(members, sequences, 3).orderBy("pos").collect()
    assert [r["context"] for r in out] == [[NO_EVENT] * 3, [NO_EVENT, NO_EVENT, "A"], [NO_EVENT, "A", "B"]]
    assert [(r["truth"], r["fallback"]) for r in out] == [(1, True)] * 3
    slow = members.withColumn("timestamp_unix_ms", F.col("pos") * F.col("pos") * 1000)
    stale = contexts(slow.withColumn("timestamp_unix_ms", F.when(F.col("pos") == 2, 3000).otherwise(F.col("pos") * 1000)), sequences, 2, 2500).orderBy("pos").collect()
    assert [r["context"] for r in stale] == [[NO_EVENT] * 2, [NO_EVENT, "A"], [NO_EVENT, "B"]]
    marked = members.withColumn("anomalous", F.when(F.col("pos") == 2, 1).otherwise(0).cast("long"))
    assert [r["truth"] for r in contexts(marked, sequences, 2).orderBy("pos").collect()] == [0, 0, 1]


def test_context_model(spark):
    members, sequences = built(spark, [(["A", "B"] * 3, 0, "train"), (["A", "X"], 0, "test"), (["B", "A"], 0, "test")])
    model = ContextModel(1, None, 2).fit(members, sequences)
    scores = {(r["window_id"], r["pos"]): r["score"] for r in model.events(members, sequences).collect()}
    assert scores[1, 1] == -2 and scores[2, 0] == -3 and scores[1, 0] == -1 and scores[2, 1] == 0
    assert {r["abstained"] for r in model.predict(members, sequences).where("split_label = 'test'").collect()} == {True}
    named = spark.createDataFrame([(s,) for s in (-1.0, -2.0, -3.0, 0.0, 1.0)], "s double").select(reason(F.col("s"))).collect()
    assert [r[0] for r in named] == ["not_confident_enough", "event_not_in_training_vocabulary", "closest_cluster_outside_epsilon", "known_benign_cluster", "known_malicious_cluster"]
    d = decision_summary(spark.createDataFrame([(1.0, 1), (0.0, 1), (-1.0, 1), (0.0, 0)], "score double, truth int")).first()
    assert (d["tp"], d["fn"], d["abstained"], d["tn"], d["coverage"]) == (1, 1, 1, 1, 0.75)


def test_nearest_rank_of_many_values(spark):
    values = [((i * 37) % 101) / 8 for i in range(400)]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.01, 0.5, 0.95, 1.0):
        assert nearest_rank(frame, "v", q) == sorted(values)[min(400, max(1, math.ceil(q * 400))) - 1]
    assert nearest_rank(frame.limit(0), "v", 0.5) is None


def test_templates_in_rounds_null_messages_and_reload(spark, monkeypatch, tmp_path):
    from seqloom.operators import templates

    monkeypatch.setattr(templates, "SEEDS", 5)
    messages = [f"took {word} from cache" for word in "ab cd ef gh ij kl mn op qr st uv wx".split()] + ["other words stand here", None]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "line_order long, untemplated_message_text string")
    model = templates.DrainParser().fit(rows)
    assert {r["template"] for r in model.templates.collect()} == {"took <:*:> from cache", "other words stand here"}
    model.save(str(tmp_path / "templates"))
    found = {r["line_order"]: (r["template"], r["params"]) for r in templates.TemplateModel.load(spark, str(tmp_path / "templates")).transform(rows).collect()}
    assert found[3] == ("took <:*:> from cache", ["gh"]) and found[13] == (None, None)
    with pytest.raises(Exception, match="no template"):
        model.transform(rows, strict=True).collect()


def test_furthest_feature(spark):
    params = lambda a, b: [str(a), str(b)]
    rows = [(0, p, "t", params(10 + p % 2, 5), 1000 * p, None) for p in range(8)] + [(1, p, "t", params(10 + p % 2, 5 if p < 5 else 900), 1000 * p, None) for p in range(6)]
    members = spark.createDataFrame(rows, MEMBERS)
    sequences = spark.createDataFrame([(0, 0, "train"), (1, 0, "test")], "window_id long, label int, split_label string")
    found = {(r["window_id"], r["pos"]): r for r in ParameterModel().fit(members, sequences).explained(members).collect()}
    odd = found[1, 5]
    assert (odd["feature"], odd["observed"]) == ("param_1", 900.0) and odd["expected"] == pytest.approx(5)
    assert found[1, 4]["feature"] == "param_0" and found[1, 4]["expected"] == pytest.approx(10.5)


def test_line_labels_from_a_table(spark):
    from seqloom.operators.labels import with_line_labels

    rows = spark.createDataFrame([(0, "a", None), (1, "b", 0), (2, "c", 1)], "line_order long, entity_id string, anomalous long")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (9, 1)], "line_order long, label int")
    assert sorted(map(tuple, with_line_labels(rows, labels).collect())) == [(0, "a", None), (1, "b", 1), (2, "c", 0)]


class OneByOne:
    """A learner that goes through sequences in order."""

    def __init__(self, form, smoothing):
        self.form, self.a = form, smoothing
        self.n, self.totals, self.counts = [0, 0], [0, 0], {}

    def score(self, x):
        if not all(self.n):
            return 1.0 if self.n[1] else 0.0 if self.n[0] else 0.5
        sums = []
        for c in (0, 1):
            if self.form == "bernoulli":
                s = math.log(self.n[c])
                for f, counts in self.counts.items():
                    p = (counts[c] + self.a) / (self.n[c] + 2 * self.a)
                    s += math.log(p if f in x else 1 - p)
            else:
                own = 1 - c if self.form == "complement" else c
                size = max(len(self.counts), 1)
                s = sum(k * math.log((self.counts.get(f, [0, 0])[own] + self.a) / (self.totals[own] + self.a * size)) for f, k in x.items())
                s = -s if self.form == "complement" else s + math.log(self.n[c])
            sums.append(s)
        return 1 / (1 + math.exp(min(700, sums[0] - sums[1])))

    def learn(self, x, y):
        self.n[y] += 1
        for f, k in x.items():
            k = 1 if self.form == "bernoulli" else k
            self.counts.setdefault(f, [0, 0])[y] += k
            self.totals[y] += k


@pytest.mark.parametrize("form", ["multinomial", "complement", "bernoulli"])
def test_online_bayes_equals_a_learner_that_goes_one_by_one(spark, form):
    rng = random.Random(5)
    labels = [rng.choice([0, 0, 1]) for _ in range(60)]
    labels[:4] = [0, 0, 1, 0]
    bags = [dict.fromkeys(rng.sample("abcdefghijklmnop", rng.randint(1, 6)), 1) for _ in labels]
    bags = [{f: rng.randint(1, 4) for f in x} | {"everywhere": 1} for x in bags]
    bags[7] = {}
    features = spark.createDataFrame([(i, f, k) for i, x in enumerate(bags) for f, k in x.items()], "window_id long, feature string, cnt long")
    split = ["train"] * 50 + ["test"] * 10
    sequences = spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(zip(labels, split))], "window_id long, label int, split_label string")
    learner, expected = OneByOne(form, 0.5), []
    for x, y in list(zip(bags, labels))[:50]:
        expected.append(learner.score(x))
        learner.learn(x, y)
    for chunk in (7, 1000):
        found = OnlineNaiveBayes(form, 0.5, chunk=chunk).progressive(features, sequences).orderBy("window_id").collect()
        assert [r["window_id"] for r in found] == list(range(50)) and [r["label"] for r in found] == labels[:50]
        assert [r["score"] for r in found] == pytest.approx(expected, abs=1e-9)
    # what is left at the end is what fitting all of training gives
    fitted = NaiveBayes(form, 0.5).fit(features, sequences).predict(features, sequences).where("window_id >= 50 OR window_id = 7").collect()
    assert {r["window_id"]: r["score"] for r in fitted} == pytest.approx({i: learner.score(bags[i]) for i in [7, *range(50, 60)]}, abs=1e-8)


def test_sums_before_follow_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), p, rng.randint(0, 9)) for p in range(200)]
    df = spark.createDataFrame(rows, "k string, p long, x long").repartition(5)
    for chunk in (1, 13, 10_000):
        for keys in (["k"], []):
            found = {r["p"]: r["s"] for r in sums_before(df, keys, "p", {"s": "x"}, chunk).collect()}
            assert found == {p: sum(x for k2, q, x in rows if q < p and (not keys or k2 == k)) for k, p, _ in rows}
    tied = df.withColumn("p", F.floor(F.col("p") / 4))
    found = sorted((r["k"], r["p"], r["x"], r["s"]) for r in sums_before(tied, ["k"], "p", {"s": "x"}, 9, ties=True).collect())
    assert found == sorted((k, p // 4, x, sum(z for k2, q, z in rows if k2 == k and q // 4 < p // 4)) for k, p, x in rows)


def plain_clusters(points, least, min_samples):
    """points: bag (sorted tuple) -> (n, worst). bag -> (core, cluster's first core)."""
    common = lambda a, b: sum((Counter(a) & Counter(b)).values())
    near = {a: [b for b in points if common(a, b) >= least] for a in points}
    cores = {a for a in points if sum(points[b][0] for b in near[a]) >= min_samples}
    cluster = {}
    for a in sorted(cores):
        if a in cluster:
            continue
        held = [a]
        while held:
            b = held.pop()
            if b not in cluster:
                cluster[b] = a
                held += [c for c in near[b] if c in cores]
    for a in points:
        if a not in cores and (close := [b for b in near[a] if b in cores]):
            cluster[a] = cluster[min(close, key=lambda b: (-common(a, b), b))]
    return {a: (a in cores, cluster.get(a)) for a in points}


@pytest.mark.parametrize("size, eps, min_samples", [(4, 0.25, 4), (5, 0.4, 6)])
def test_density_clusters_equal_a_plain_version(spark, size, eps, min_samples):
    rng = random.Random(size)
    sequences = [([rng.choice("aaabbcdefghij") for _ in range(rng.randint(1, 25))], rng.choice([0, 0, 1]), rng.choice(["train", "train", "test"])) for _ in range(60)]
    sequences.append((["never seen", "a"], 0, "test"))
    members, rows = built(spark, sequences)
    model = ClusteredContexts(size, None, min_samples, eps).fit(members, rows)
    least = common_places(size, eps)
    bags, asked = {}, []
    for i, (ts, label, split) in enumerate(sequences):
        for p, t in enumerate(ts):
            bag = tuple(sorted(([NO_EVENT] * size + ts[:p])[-size:]))
            asked.append((i, p, t, bag))
            if split == "train":
                n, worst = bags.setdefault(t, {}).get(bag, (0, 0))
                bags[t][bag] = n + 1, max(worst, label)
    plain = {t: plain_clusters(points, least, min_samples) for t, points in bags.items()}
    found = {(r["template"], tuple(r["bag"].split("\x1f"))): (r["core"], r["cluster"] and tuple(r["cluster"].split("\x1f"))) for r in model.points.collect()}
    assert found == {(t, bag): x for t, points in plain.items() for bag, x in points.items()}
    worst = {}
    for t, points in plain.items():
        for bag, (_, cluster) in points.items():
            if cluster:
                worst[t, cluster] = max(worst.get((t, cluster), 0), bags[t][bag][1])
    common = lambda a, b: sum((Counter(a) & Counter(b)).values())
    expected = {}
    for i, p, t, bag in asked:
        if t not in bags:
            expected[i, p] = -2.0
            continue
        close = [b for b in bags[t] if common(bag, b) >= least]
        best = min(close, key=lambda b: (-common(bag, b), b)) if close else None
        expected[i, p] = -3.0 if best is None else worst[t, plain[t][best][1]] if plain[t][best][1] else -1.0
    assert {(r["window_id"], r["pos"]): r["score"] for r in model.events(members, rows).collect()} == expected
    assert model.predict(members, rows).count() == len(sequences)


def test_clusters_of_nothing(spark):
    members, rows = built(spark, [(["a", "b"], 0, "test")])
    model = ClusteredContexts(2).fit(members, rows)
    assert model.points.count() == 0 and {r["score"] for r in model.events(members, rows).collect()} == {-2.0}
    with pytest.raises(ValueError, match="eps"):
        common_places(3, 1.0)


def plain_templates(messages, similarity):
    """Templates of token lists in order, leaf by leaf."""
    wild, leaves, out = "<:*:>", {}, set()
    for tokens in messages:
        lead = wild if any(c.isdigit() for c in tokens[0]) else tokens[0]
        own = leaves.setdefault((len(tokens), lead), [])
        if tokens not in own:
            own.append(tokens)
    same = lambda a, b: sum(x == y for x, y in zip(a, b))
    for own in leaves.values():
        seeds = []
        for tokens in own:
            if all(same(s, tokens) < similarity * len(tokens) for s in seeds):
                seeds.append(tokens)
        members = {}
        for tokens in own:
            best = max(range(len(seeds)), key=lambda i: (same(seeds[i], tokens), -i))
            members.setdefault(best, []).append(tokens)
        for rows in members.values():
            out.add(" ".join(column[0] if len(set(column)) == 1 else wild for column in zip(*rows)))
    return out


@pytest.mark.parametrize("seeds", [5, 256])
def test_templates_depend_on_neither_size_nor_partitions(spark, monkeypatch, seeds):
    from seqloom.operators import templates

    monkeypatch.setattr(templates, "SEEDS", seeds)
    rng = random.Random(3)
    words = [f"{c}word" for c in "abcdefgh"]
    messages = [["go", *(rng.choice(words) for _ in range(rng.choice([3, 5])))] for _ in range(60)] + [["x1", "y"], ["x2", "y"], ["z"]]
    rng.shuffle(messages)
    rows = spark.createDataFrame([(i, " ".join(m)) for i, m in enumerate(messages)] + [(999, ""), (1000, "  ")], "line_order long, untemplated_message_text string")
    for similarity in (0.4, 0.6):
        expected = plain_templates(messages, similarity) | {""}
        assert len(expected) > 5
        for parts in (1, 3, 50) if similarity == 0.4 and seeds == 256 else (7,):
            model = templates.DrainParser(similarity).fit(rows.repartition(parts))
            assert {r["template"] for r in model.templates.collect()} == expected
    # each message has a template that fits, the most literal one
    for r in model.transform(rows).collect():
        tokens, template = r["untemplated_message_text"].split(), r["template"].split()
        assert len(tokens) == len(template) and [t for t, x in zip(tokens, template) if x == "<:*:>"] == r["params"]
        fits = [t for t in expected if len(t.split()) == len(tokens) and all(x in (w, "<:*:>") for w, x in zip(tokens, t.split()))]
        assert r["template"] == max(fits, key=lambda t: (sum(x != "<:*:>" for x in t.split()), t))


@pytest.mark.parametrize("timeout", [None, 2500])
def test_one_long_sequence_in_many_ranges(spark, timeout):
    """One entity has all rows: gaps, histories, contexts and residuals are the same in ranges of any size, and no task has them all."""
    rng = random.Random(6)
    rows = [(0, p, rng.choice("abc"), [str(rng.randint(0, 9)), rng.choice(["1", "x"])], rng.choice([None, 1000 * p, 1000 * p + rng.randint(0, 900)]), None) for p in range(60)]
    members = spark.createDataFrame(rows, MEMBERS).repartition(6)
    sequences = spark.createDataFrame([(0, 0, "train", 60)], "window_id long, label int, split_label string, event_count long")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    last, gaps = None, {}
    for _, p, _, _, ts, _ in rows:
        gaps[p] = ts - last if None not in (ts, last) else None
        last = ts if ts is not None else last
    model = lambda chunk: ParameterModel(3, chunk=chunk)
    values = parameter_values(members)
    scale = normalisation(values, parameter_schema(values))
    whole = [order(f(1000)) for f in (lambda c: contexts(members, sequences, 4, timeout, c).drop("params"), lambda c: history_pairs(members, 4, c))]
    assert [h for *_, h in sorted((p, h) for _, p, _, h in [(r["window_id"], r["pos"], 0, r["history"]) for r in history_pairs(members, 4).collect()])] == [[rows[q][2] for q in range(p - 4, p)] for p in range(4, 60)]
    residuals = {(r["window_id"], r["pos"], r["template"]): r["residual"] for r in model(1000).series(values, scale).collect()}
    assert len(residuals) > 20
    for chunk in (2, 30):
        found = {r["pos"]: r["gap"] for r in with_time_gaps(members, "gap", chunk).collect()}
        assert found == gaps
        assert order(contexts(members, sequences, 4, timeout, chunk).drop("params")) == whole[0]
        assert order(history_pairs(members, 4, chunk)) == whole[1]
        again = {(r["window_id"], r["pos"], r["template"]): r["residual"] for r in model(chunk).series(values, scale).collect()}
        assert again == pytest.approx(residuals)
    dealt = items_before(members, ["window_id"], "pos", F.struct("template"), 4, "past", 7).groupBy(F.floor(F.col("pos") / 7)).count()
    assert dealt.count() == 9
