"""Order MinHash: alignment, sketches, classes; and the pipeline."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import order_minhash


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = [rng.randrange(6)] * rng.randrange(2)
        most = rng.randint(0, 12)
        assert order_minhash.alignable(a, b, most) == (edit_distance(a, b) <= most)
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        for band in range(max(1, len(long) - len(short)), len(long)):
            assert order_minhash.within_band(long, short, band) == (edit_distance(a, b) <= band)


def test_sketches_see_order_and_repeats():
    words = np.random.default_rng(1).integers(1, 2**62, 300).astype(np.uint64)
    own = order_minhash.order_sketches(words)
    assert (own == order_minhash.order_sketches(words)).all() and len(own) == order_minhash.SKETCHES
    turned = np.concatenate([words[150:], words[:150]])
    assert (own == order_minhash.order_sketches(turned)).mean() < 0.75
    assert len(order_minhash.order_sketches(words[:3])) == order_minhash.SKETCHES and not len(order_minhash.order_sketches(words[:0]))
    edited = words.copy()
    edited[::60] = 7
    assert (own == order_minhash.order_sketches(edited)).any()


def corpus():
    rng = random.Random(8)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, doc = [], 0
    passage = prose(60)
    for _ in range(12):  # families of near copies, each member edited for itself
        base = prose(rng.randint(40, 200))
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
            rows.append((doc, " ".join(own)))
            doc += 1
    for _ in range(40):  # unlike texts that share a passage
        rows.append((doc, " ".join(prose(120) + passage)))
        doc += 1
    for _ in range(15):  # exact copies but for case and space
        rows.append((doc, "  Some COPY  of words\n" * 3 if doc % 2 else "some copy of words " * 3))
        doc += 1
    rows += [(doc, ""), (doc + 1, None), (doc + 2, "two words"), (doc + 3, "two words"), (doc + 4, " ".join(prose(15000))), (doc + 5, rows[0][1]), (doc + 5, rows[0][1]), (None, "a null id")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    words = [order_minhash.compared_bytes(t or "").split() for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = words[i], words[j]
            if len(a) == len(b) == 0 or (len(a) and len(b) and order_minhash.similar(a, b)):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return {i: min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(rows))}


def test_classes_against_all_pairs(spark):
    rows = corpus()
    expected = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("_node", F.lit("y"))
    out = order_minhash.near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["class_id"]) for r in out), key=repr) == sorted(((d, expected[i]) for i, (d, _) in enumerate(rows)), key=repr)
    kept = order_minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(set(expected.values()), key=repr)


def test_families_that_share_a_passage(spark):
    # copies have nothing but the passage's shingles in common, so each of their buckets holds all families
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, rows = prose(30), []
    for family in range(9):
        base = prose(10)
        for k in range(3):
            base[0], base[5] = f"a{family}x{k}", f"b{family}x{k}"
            rows.append((len(rows), " ".join(passage + base)))
    expected = brute(rows)
    assert len(set(expected.values())) == 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs).collect()} == expected


@pytest.mark.parametrize("crowd", [1 << 20, 10])
def test_open_links_join_what_alignable_pairs_join(spark, monkeypatch, crowd):
    """Blocks of a few texts, and buckets by rare word pairs, against all pairs."""
    monkeypatch.setattr(order_minhash, "BLOCK_TEXTS", 30)
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [rng.randrange(12) for _ in range(rng.randint(1, 30))]
        texts += [[x if rng.random() > 0.12 else rng.randrange(12) for x in base] for _ in range(4)]
    texts = [[b"%d" % x for x in t] for t in sorted({tuple(x) for x in texts})]
    n = range(len(texts))
    labels = spark.createDataFrame([(i, i) for i in n], "node long, label long")
    member = spark.createDataFrame([(i % 2, i) for i in n] + [(5, i) for i in range(6)] + [(8 + i % 2, i) for i in n if i % 3], "bucket long, node long")
    pool = spark.createDataFrame([(i, bytearray(b" ".join(texts[i])), len(texts[i])) for i in n], "node long, words binary, n int")

    def joined(links):
        label = list(n)
        for i, j in links:
            label = [label[j] if x == label[i] else x for x in label]
        return [label.index(x) for x in label]

    for similarity in (0.8, 0.6):
        found = {tuple(r) for r in order_minhash.open_links(labels, member, pool, similarity, crowd).collect()}
        together = lambda i, j: (i - j) % 2 == 0 or i < 6
        wanted = {(i, j) for i in n for j in range(i) if together(i, j) and order_minhash.similar(texts[i], texts[j], similarity)}
        assert found <= wanted and len(found) <= len(wanted)
        assert joined(found) == joined(wanted)


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def linked_share(spark, rows, pairs):
    found = {r["doc_id"]: r["label"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    return sum(found[a] == found[b] for a, b in pairs) / len(pairs)


@pytest.mark.parametrize(("edits", "shared"), [(20, 0), (20, 78), (14, 78)])
def test_recall(spark, edits, shared):
    """Pairs of 100 words of which some are replaced at random places; all texts may share a passage, so that each is a candidate of each."""
    rng = random.Random(edits)
    passage = [f"p{i}" for i in range(shared)]
    rows, pairs = [], []
    for i in range(150):
        base = passage + [f"w{rng.randrange(10**9)}" for _ in range(100 - shared)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, edits)))]
        pairs.append((2 * i, 2 * i + 1))
    assert linked_share(spark, rows, pairs) >= 0.9


def mixed_edits(rng, words, edits):
    """Replacements, insertions and deletions."""
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + rng.randrange(2)] = [f"x{rng.randrange(10**9)}"] * rng.randrange(2)
    return out


def test_recall_of_short_texts(spark):
    """Pairs of 5 to 48 words at a similarity of 0.9, 0.85 and 0.8: those of up to 40 words are all found."""
    rng = random.Random(7)
    rows, pairs = [], {}
    for n in (5, 7, 10, 15, 20, 25, 30, 40, 48):
        for share in (0.1, 0.15, 0.2):
            for k in range(40):
                base = [f"w{rng.randrange(10**9)}" if k % 2 else f"v{rng.randrange(2000)}" for _ in range(n)]
                other = (edited if k % 3 else mixed_edits)(rng, base, int(n * share + 1e-9))
                if order_minhash.similar(base, other):
                    pairs.setdefault((n, share), []).append((len(rows), len(rows) + 1))
                    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    found = {r["doc_id"]: r["label"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    share = {k: sum(found[a] == found[b] for a, b in v) / len(v) for k, v in pairs.items()}
    assert min(v for (n, _), v in share.items() if n <= 40) == 1 and min(share.values()) >= 0.9, share
    # and nothing else is
    assert len(set(found.values())) >= len(rows) // 2 - sum(len(v) for v in pairs.values() if not v)


def test_parity_sketches_let_all_alignable_pairs_through():
    rng = random.Random(9)
    texts = []
    for n in (5, 12, 60, 300, 420, 512, 700, 2100, 2600):
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        texts += [base, mixed_edits(rng, base, n // 5), mixed_edits(rng, base, n // 9), [f"w{rng.randrange(400)}" for _ in range(n)]]
    rng.shuffle(texts)
    rows = [(i, len(t), order_minhash.parity_sketch(order_minhash.short_hashes(" ".join(t).encode()))) for i, t in enumerate(texts)]
    near = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and order_minhash.similar(a, b)}
    assert len(near) >= 20
    some, more = order_minhash.involved(rows, None, 0.8)
    assert {i for i, _ in near} <= some | more and len(some | more) < len(texts) - 5
    for i, j in near:
        assert order_minhash.involved([rows[i]], [rows[j]], 0.8) == ({0}, {0})
    # one label: nothing to find
    assert order_minhash.involved([(0, *r[1:]) for r in rows], None, 0.8) == (set(), set())


def test_classes_of_one_id(spark):
    words = lambda k: " ".join(f"t{k}w{i}" for i in range(12))
    # unlike texts without ids, copies of one of them, and one id with two unlike texts and two similar ones
    rows = [(None, words(1)), (None, words(2)), (None, words(3)), (None, words(3)), (None, words(3) + " more"), (7, words(4)), (7, words(5)), (7, words(5) + " more"), (8, words(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r["doc_id"], r["text"].removesuffix(" more")) for r in order_minhash.one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == sorted([(None, words(1)), (None, words(2)), (None, words(3)), (7, words(4)), (7, words(5))], key=repr)
    out = order_minhash.near_duplicates(docs)
    assert out.select("label").distinct().count() == 5 and out.where("kept").select("label").distinct().count() == 5


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert order_minhash.near_duplicates(docs).isEmpty() and order_minhash.one_of_each(docs).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10] + [(7, 100), (100, 50)]
    out = order_minhash.components(spark.createDataFrame(edges, "u long, v long"))
    label = {r["node"]: r["label"] for r in out.collect()}
    assert len(label) == len({x for e in edges for x in e if label.get(x) is not None})
    assert label[10] == 1 and label[50] == 1 and label[40] == 31


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    from seqloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "tokens":
            assert out.columns == docs.columns
            out = out.cache()
            docs = out
        sizes.append(out.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[2] == sizes[5]
    ids = {r["doc_id"] for r in pipeline.run(spark, sf_dir).select("doc_id").collect()}
    assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
    bench = table(spark, sf_dir, "benchmark")
    from seqloom.llm.decontaminate import contamination

    assert contamination(docs, bench).where("contaminated").isEmpty()
