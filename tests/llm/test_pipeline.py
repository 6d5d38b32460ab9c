"""The classifier's training and the whole pipeline against plain Python versions."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqloom.llm import order_minhash, quality_ftrl

M = 1 << 64


def plain_features(text, bits):
    """place -> count / sqrt(number of all), as the classifier's docstring says."""
    kind = lambda b: 0 if b < 33 or b == 127 else 1 if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127 else 2
    tokens, last = [], 0
    for b in (text or "").encode():
        if kind(b):
            if kind(b) != last:
                tokens.append([])
            tokens[-1].append(b)
        last = kind(b)
    hashes = []
    for t in tokens:
        h = sum((b + 1) * pow(int(quality_ftrl.BASE), i, M) for i, b in enumerate(t)) % M
        hashes.append(((h ^ (h >> 29)) * int(quality_ftrl.ODD)) % M)
    every = list(hashes)
    for a, b in zip(hashes, hashes[1:]):
        every.append(((a * int(quality_ftrl.PAIR) + b) * int(quality_ftrl.ODD)) % M)
        if a == b:
            every.append(int(quality_ftrl.AGAIN))
    places = {}
    for h in every:
        places[h >> (64 - bits)] = places.get(h >> (64 - bits), 0) + 1
    return {p: n / math.sqrt(len(every)) for p, n in places.items()}


def plain_score(weights, bias, text, bits):
    dot = bias + sum(weights.get(p, 0.0) * v for p, v in plain_features(text, bits).items())
    return 1 / (1 + math.exp(-max(-30, min(30, dot))))


def plain_ftrl(examples, bits, epochs=2, alpha=1.0, beta=1.0, l1=0.02, l2=0.3):
    """Weights by coordinate; None is the bias."""
    z, n = {}, {}

    def weight(p):
        if abs(z.get(p, 0.0)) <= l1:
            return 0.0
        return -(z[p] - math.copysign(l1, z[p])) / ((beta + math.sqrt(n[p])) / alpha + l2)

    for _ in range(epochs):
        for text, label in examples:
            x = {**plain_features(text, bits), None: 1.0}
            w = {p: weight(p) for p in x}
            p_one = 1 / (1 + math.exp(-max(-30, min(30, sum(w[p] * v for p, v in x.items())))))
            for p, v in x.items():
                g = (p_one - label) * v
                step = (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / alpha
                z[p] = z.get(p, 0.0) + g - step * w[p]
                n[p] = n.get(p, 0.0) + g * g
    return {p: weight(p) for p in z}


def test_training_against_plain_ftrl(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("good bad fine odd !! $$ x y".split()) for _ in range(rng.randint(0, 25))) for _ in range(90)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "a second text of id three"), (3, texts[3]), (None, "no id"), (200, None)]
    labels = [(i, rng.randint(0, 1)) for i in range(90)] + [(5, 1), (5, 0), (200, 1), (None, 1), (7, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    order = {r["doc_id"]: r["h"] for r in d.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    own = {r["text"] or "": r["h"] for r in d.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    held = {r["doc_id"] for r in d.select("doc_id").distinct().where(quality_ftrl.held_out()).collect()}
    for most in (10_000, 20):
        known = sorted((order[i], i, y) for i, y in labels if i is not None and y is not None and i not in held)[:most]
        rows = sorted((h, i, y, own[t or ""], t or "") for h, i, y in known for k, t in docs if k == i)[:most]
        expected = plain_ftrl([(t, y) for *_, y, _, t in rows], 18)
        model = quality_ftrl.fit(d, lab, max_rows=most)
        assert model.bias == pytest.approx(expected[None], abs=1e-5)
        for p, w in expected.items():
            assert p is None or model.weights[p] == pytest.approx(w, abs=1e-5)
        assert set(np.flatnonzero(model.weights)) <= set(expected)
        scores = {(r["doc_id"], r["score"]) for r in quality_ftrl.score(d, model).collect()}
        assert {i for i, _ in scores} == {i for i, _ in docs}
        for i, t in docs[:30]:
            want = plain_score(expected, expected[None], t, 18)
            assert any(k == i and abs(s - want) < 1e-5 for k, s in scores)


def plain_windows(words, width=10):
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_pipeline(docs, model, bench):
    """docs (id, text) to the rows that stay, with the texts that each ends with."""
    weights = {int(p): float(model.weights[p]) for p in np.flatnonzero(model.weights)}
    rows = [(d, t) for d, t in docs if plain_score(weights, model.bias, t, model.bits) >= 0.5]
    # one of each class of near copies
    words = [order_minhash.compared_bytes(t or "").split() for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if words[i] == words[j] or (words[i] and words[j] and order_minhash.similar(words[i], words[j])):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, w, (d, t) in zip(group, words, rows):
        key = (d is None, d or 0, hashlib.blake2b(b" ".join(w), digest_size=16).digest())
        if g not in least or key < least[g][0]:
            least[g] = (key, d, t)
    rows = [(d, t) for _, d, t in least.values()]
    # windows of 50 words that an earlier document has
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    cut = []
    for d, t in rows:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        parts = re.findall(r"[^ \t-\r]+[ \t-\r]*", t or "")
        cut.append((d, (t[: len(t) - len("".join(parts))] + "".join(x for k, x in enumerate(parts) if k not in gone)) if gone else t))
    # words of the benchmark
    windows = set().union(*(plain_windows(WORD.findall(low(t or ""))) for t in bench))
    out = []
    for d, t in cut:
        found, gone = WORD.findall(low(t or "")), set()
        for width in {len(w) for w in windows}:
            for i in range(len(found) - width + 1):
                if tuple(found[i : i + width]) in windows:
                    gone |= set(range(i, i + width))
        if gone:
            parts = re.findall(WORD.pattern + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", t)
            t = t[: len(t) - len("".join(parts))] + "".join(x for k, x in enumerate(parts) if k not in gone)
        out.append((d, t))
    return out


def tables(spark, folder, docs, labels, bench):
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "z", 7) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, _row string, _spans int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_against_plain_python(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    import sentencepiece

    rng = random.Random(9)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    junk = lambda n: " ".join(rng.choice(["BUY!!", "$$$", "win", "w1"]) for _ in range(n))
    passage, item = prose(60), "one two three four five six seven eight nine ten eleven twelve"
    docs = [(i, prose(rng.randint(30, 90))) for i in range(40)]
    docs += [(100 + i, f"{prose(80)} {passage}\n\n{prose(70)}") for i in range(4)]
    docs += [(200 + i, docs[0][1] + " more") for i in range(2)] + [(210, docs[1][1].upper()), (210, docs[1][1].upper())]
    docs += [(300 + i, f"{prose(20)}\n{item.title()}, {prose(15)}\tshort Item!") for i in range(3)]
    docs += [(400 + i, junk(60)) for i in range(40)]
    docs += [(500, None), (501, ""), (502, "short item"), (None, prose(40)), (None, prose(45)), (503, prose(9000))]
    rng.shuffle(docs)
    labels = [(d, int(d < 400), 0) for d, _ in docs if d is not None] + [(500, None, 0), (None, 1, 0), (0, 1, 0)]
    bench = [item, "short item", None, "!!", item]
    folder = tables(spark, tmp_path / "small", docs, labels, bench)
    model = quality_ftrl.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = [(d, library.encode(t or "")) for d, t in plain_pipeline(docs, model, bench)]
    got = [(r["doc_id"], list(r["ids"])) for r in pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert 40 < len(expected) < len(docs)


def test_pipeline_of_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = tables(spark, tmp_path / "none", [(1, "x")], [(1, 1, 0)], ["x"])
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, str(empty)).isEmpty()
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_passages", "tokens"]
