"""Vector codes, hard negatives and SimHash, each against a plain version."""

import random
from fractions import Fraction
from math import floor

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import hard_negatives, simhash_pivots, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, row string"


def awkward_vectors(n=130, width=16, seed=5):
    """Ties, repeats, nulls and columns whose names clash with those that the operators make."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = rng.choice([0, 0, 0, 1, 2, None])
        vector = [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.5]) if i % 3 else rng.uniform(-1, 1) for _ in range(width)]
        rows.append((i * 5, vector, label, "x", "y"))
    same = rows[7][1]
    rows += [(1000 + i, same, 0, "x", "y") for i in range(40)]  # one vector very often
    rows += [(1050, None, 0, "x", "y"), (1100, [1.0] * (width - 1) + [None], 0, "x", "y"), (1150, [float("nan")] * width, 0, "x", "y"), (1200, [float("inf")] + [0.0] * (width - 1), 0, "x", "y")]
    rows += [(None, same, 0, "x", "y"), (None, same, None, "x", "y"), (50, same, 0, "x", "y"), (50, same, 0, "x", "y")]
    return rows


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [floor(Fraction(x) * 4096) for x in np.array(v, np.float32).tolist()], label) for i, v, label, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    least = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in least] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, cut(v, p))[1] for _, v, _ in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), at in zip(kept, found[p]) if at == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v, label in kept:
        near = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in near), sum(d for d, _ in near)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    books = vector_codes.Codebooks(tuple(tuple(map(tuple, b)) for b in books))
    return sorted(((*r, total[r[1]], books.sha256()) for r in out), key=repr), books


def test_annulus_equals_all_entries():
    rng = np.random.default_rng(3)
    for width, size, k in ((1, 3, 16), (8, 40, 16), (8, 1 << 27, 16), (4, 2, 5), (2, 0, 3), (8, 1000, 1)):
        entries, parts = rng.integers(-size, size + 1, (k, width)), rng.integers(-size, size + 1, (500, width))
        index, best = vector_codes.annulus(entries, parts)
        all_ = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == all_.min(axis=1)).all() and (index == all_.argmin(axis=1)).all()


def test_annulus_holds_both_ends_and_little_else():
    norms = np.array([0.0, 3.0, 5.0, 5.0, 7.0, 90.0])
    size, best = np.array([5.0, 5.0, 4.0, 60.0, 1.0]), np.array([0, 4, 1, 900, 1])
    lo, hi = vector_codes.allowed(norms, size, best)
    assert list(zip(lo.tolist(), hi.tolist())) == [(2, 4), (1, 5), (1, 4), (5, 6), (0, 1)]


def test_vector_codes_equal_a_plain_version(spark):
    rows = awkward_vectors()
    expected, books = plain_codes(rows)
    df = spark.createDataFrame(rows, VECTORS)
    for parts in (1, 7):
        out = vector_codes.compress(df.repartition(parts))
        assert sorted(map(tuple, out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr) == expected
    back = vector_codes.decode(out, books).where("vec_id = 35").first()
    code = bytes.fromhex(back["code"])
    assert back["vector"] == [x / 4096 for p, k in enumerate(code) for x in books.books[p][k]]


def test_vector_codes_of_few_rows(spark):
    rows = awkward_vectors()
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 0, "", "")], VECTORS)).count() == 0
    few = rows[:3]
    out = vector_codes.compress(spark.createDataFrame(few, VECTORS)).collect()
    assert len(out) == 3 and all(r["error"] == 0 for r in out)
    with pytest.raises(Exception, match="components"):
        vector_codes.compress(spark.createDataFrame([(1, [0.0] * 8, 0, "", ""), (2, [0.0] * 16, 0, "", "")], VECTORS))
    with pytest.raises(Exception, match="8 parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.0] * 9, 0, "", "")], VECTORS))
    with pytest.raises(Exception, match="component"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 0, "", "")], VECTORS))


def plain_negatives(rows):
    kept = []
    for i, v, label, *_ in rows:
        if label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [floor(Fraction(x) * 256) for x in np.array(v, np.float32).tolist()]))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), j, other == label) for b, (j, other, w) in enumerate(kept) if b != a]
        for positive, pid, _ in sorted((s for s in scored if s[2]), key=key)[:5]:
            near = sorted((s for s in scored if not s[2] and 50 * positive <= 100 * s[0] <= 95 * positive), key=key)[:3]
            out += [(i, pid, rank, s[1], positive, s[0]) for rank, s in enumerate(near, 1)]
    return sorted(out, key=repr)


def mined(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine(df, F.col("id") % 50 == 0, label=label, **options)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def test_hard_negatives_equal_a_plain_version(spark):
    rows = awkward_vectors(300)
    expected = plain_negatives(rows)
    assert len(expected) > 50
    df = spark.createDataFrame(rows, VECTORS)
    assert mined(df) == expected
    # many blocks, chunks that don't divide the width, several panels
    assert mined(df.repartition(5), row_block=20, anchor_block=4, chunk=3, panel=8) == expected


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(50, [1.0] * 8, 1, "", "")], VECTORS)) == []
    # no anchors; no positives; no negatives
    assert mined(spark.createDataFrame([(51, [1.0] * 8, 1, "", ""), (52, [1.0] * 8, 1, "", "")], VECTORS)) == []
    assert mined(spark.createDataFrame([(50, [1.0] * 8, 1, "", ""), (52, [1.0] * 8, 2, "", "")], VECTORS)) == []
    assert mined(spark.createDataFrame([(50, [1.0] * 8, 1, "", ""), (52, [1.0] * 8, 1, "", "")], VECTORS)) == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 25):
        a, b = rng.integers(-most, most, (7, 32)), rng.integers(-most, most, (9, 32))
        assert (hard_negatives.product(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a])).all()
        assert (hard_negatives.unpacked(hard_negatives.packed(a)) == a).all()
    assert hard_negatives.unpacked(hard_negatives.packed(np.array([[-128, 127]]))).tolist() == [[-128, 127]]


def plain_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=2):
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def texts():
    rng = random.Random(4)
    rows = [(90, None), (91, ""), (92, " \t\x0b\x0c\r\n"), (93, "one"), (94, "ONE  "), (95, "two words"), (96, "two\x1cwords"), (97, "É é x y z"), (None, "two words"), (None, "quite alone here now")]
    doc = 0
    for _ in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 400]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                own[rng.randrange(len(own))] = f"e{rng.randrange(99)}"
            rows.append((doc, "  ".join(own).upper() if doc % 2 else "\n".join(own)))
            doc += 1
    rows += [rows[20], (rows[20][0], "another text of this id"), (98, "long " * 50_000 + "end"), (99, " ".join(f"x{i % 997}" for i in range(120_000)))]
    return rows


def test_fingerprints_equal_a_plain_version():
    rows = texts()
    assert [int(x) for x in simhash_pivots.fingerprints([t for _, t in rows])] == [plain_print(t) for _, t in rows]


def test_simhash_components_equal_a_plain_version(spark):
    rows = texts()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, print string, id int")
    expected = plain_components(rows)
    assert len({r[2] for r in expected}) < len(expected) - 20
    assert sorted(map(tuple, simhash_pivots.near_duplicates(df.repartition(6)).collect()), key=repr) == expected
    assert simhash_pivots.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [simhash_pivots.BLOCK, 7])
def test_links_of_dense_clusters(spark, block):
    """Fingerprints around one centre, in chains and far apart: keys of many fingerprints are cut and dealt over blocks."""
    rng = random.Random(block)
    centre = rng.getrandbits(64)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(400):
        x = centre
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {centre ^ ((1 << k) - 1) for k in range(0, 64, 3)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    found = simhash_pivots.links(spark.createDataFrame(signed, "print long"), block).collect()
    root = {x: x for (x,) in signed}

    def find(root, x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in found:
        root[find(root, u)] = find(root, v)
    own = {x: x for (x,) in signed}
    values = [x for (x,) in signed]
    for i, x in enumerate(values):
        for y in values[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                own[find(own, x)] = find(own, y)
    same = lambda r: {x: min(y for y in values if find(r, y) == find(r, x)) for x in values}
    assert same(root) == same(own)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = prints[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    both = np.concatenate([prints, near])
    table = simhash_pivots.distance_table(both)
    i, j = rng.integers(0, 4000, 200_000), rng.integers(0, 4000, 200_000)
    i, j = np.concatenate([i, np.arange(1000)]), np.concatenate([j, np.arange(3000, 4000)])
    a, b = simhash_pivots.close_pairs(both, table, i, j)
    expected = np.bitwise_count(both[i] ^ both[j]) <= 2
    assert (a == i[expected]).all() and (b == j[expected]).all()
    # the tables alone leave few of the others
    left = (np.abs(table[:, i].astype(int) - table[:, j]) <= 2).all(axis=0)
    assert (left & ~expected).mean() < 0.001
