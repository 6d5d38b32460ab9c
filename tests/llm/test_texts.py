"""JPEG columns, the classifier, chat formatting, decontamination and the two dedup operators against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import bwt_repeats, decontaminate, preference_chat, progressive_jpeg, quality_ftrl, window_dedup
from seqloom.llm.superkmers import super_kmers

# --- progressive JPEG -----------------------------------------------------------------------------


def test_payload_round_trip():
    rng = random.Random(1)
    for n in (1, 2, 63, progressive_jpeg.WIDE + 1):
        payload = bytes(rng.randrange(256) for _ in range(n * 192))
        image = progressive_jpeg.decode_image(progressive_jpeg.encode_payload(payload))
        assert progressive_jpeg.payload_of(image) == payload


def test_array_reading_equals_symbol_reading(monkeypatch):
    payload = bytes(range(256)) * 3
    media = progressive_jpeg.encode_payload(payload)
    fast = progressive_jpeg.decode_image(media)
    monkeypatch.setattr(progressive_jpeg, "whole_scan", lambda *a: False)
    slow = progressive_jpeg.decode_image(media)
    assert all((a == b).all() for a, b in zip(fast.coefficients, slow.coefficients))


class Writer:
    """A progressive encoder of its own: 4:2:0, restart intervals, zero runs, end-of-band runs and new coefficients in refinements."""

    def __init__(self):
        # any 8-bit symbol, 8 bits each but the last two
        self.codes = {s: f"{s:08b}" for s in range(254)} | {254: "111111100", 255: "111111101"}

    def table(self, kind):
        return progressive_jpeg.table_segment(kind, 0, {s: len(c) for s, c in self.codes.items()})

    @staticmethod
    def value(v):
        s = abs(v).bit_length()
        return f"{v if v > 0 else v + (1 << s) - 1:0{s}b}" if s else ""

    @staticmethod
    def pack(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    def first(self, blocks, start, end, low):
        out, run = "", 0

        def flush():
            nonlocal out, run
            while run:
                r = min(run.bit_length() - 1, 14)
                out += self.codes[r << 4] + (f"{run - (1 << r):0{r}b}" if r else "")
                run = 0

        for b in blocks:
            zeros = 0
            values = [int(abs(v)) >> low if v > 0 else -(int(abs(v)) >> low) for v in b[start : end + 1]]
            last = max((i for i, v in enumerate(values) if v), default=-1)
            if last >= 0:
                flush()
            for v in values[: last + 1]:
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    out, zeros = out + self.codes[0xF0], zeros - 16
                out, zeros = out + self.codes[zeros << 4 | abs(v).bit_length()] + self.value(v), 0
            if last < len(values) - 1:
                run += 1
        flush()
        return out

    def refine(self, blocks, start, end, low):
        out = ""
        for b in blocks:
            values = [int(v) for v in b[start : end + 1]]
            size = [abs(v) >> low for v in values]
            last = max((i for i, s in enumerate(size) if s == 1), default=-1)
            zeros, pending = 0, ""
            for i, s in enumerate(size):
                if i > last:
                    break
                if s > 1:
                    pending += str(s & 1)
                elif s == 1:
                    out += self.codes[zeros << 4 | 1] + ("1" if values[i] > 0 else "0") + pending
                    zeros, pending = 0, ""
                else:
                    zeros += 1
                    if zeros == 16:
                        out, zeros, pending = out + self.codes[0xF0] + pending, 0, ""
            if last < len(size) - 1:
                out += self.codes[0] + pending + "".join(str(s & 1) for s in size[last + 1 :] if s > 1)
        return out


def test_any_progressive_file():
    rng = np.random.default_rng(3)
    height, width = 24, 40
    shapes = [(4, 6), (2, 3), (2, 3)]  # blocks of a luma and two chroma planes, padded to whole units
    planes = [np.where(rng.random((*s, 64)) < 0.15, rng.integers(-60, 61, (*s, 64)), 0) for s in shapes]
    for p in planes:
        p[..., 0] = rng.integers(-200, 200, p.shape[:2])
    w = Writer()
    data = [b"\xff\xd8", progressive_jpeg.segment(0xDB, b"\x00" + bytes([3] * 64))]
    data.append(progressive_jpeg.segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
    data += [w.table(0), w.table(1), progressive_jpeg.segment(0xDD, (2).to_bytes(2, "big"))]

    def head(cs, *rest):
        return progressive_jpeg.segment(0xDA, bytes([len(cs)]) + b"".join(bytes([c, 0]) for c in cs) + bytes(rest))

    units = [[(c, r * v + y, k * v + x) for c, v in ((0, 2), (1, 1), (2, 1)) for y in range(v) for x in range(v)] for r in range(2) for k in range(3)]
    for high, low in ((0, 1), (1, 0)):
        pieces = []
        for i in range(0, len(units), 2):
            bits, before = "", [0, 0, 0]
            for c, y, x in (u for unit in units[i : i + 2] for u in unit):
                v = int(planes[c][y, x, 0])
                if high:
                    bits += str(v & 1)
                else:
                    d = (v >> 1) - before[c]
                    before[c] = v >> 1
                    bits += w.codes[abs(d).bit_length()] + w.value(d)
            pieces.append(w.pack(bits))
        joined = pieces[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + p for i, p in enumerate(pieces[1:]))
        data.append(head([1, 2, 3], 0, 0, high << 4 | low) + joined)
    data.append(progressive_jpeg.segment(0xDD, (0).to_bytes(2, "big")))
    for c, (rows, columns) in ((0, (3, 5)), (1, (2, 3)), (2, (2, 3))):
        blocks = [planes[c][y, x] for y in range(rows) for x in range(columns)]
        for a, b in ((1, 5), (6, 63)):
            data.append(head([c + 1], a, b, 0x01) + w.pack(w.first(blocks, a, b, 1)))
            data.append(head([c + 1], a, b, 0x10) + w.pack(w.refine(blocks, a, b, 0)))
    image = progressive_jpeg.decode_image(b"".join([*data, b"\xff\xd9"]))
    for got, p, (rows, columns) in zip(image.coefficients, planes, ((3, 5), (2, 3), (2, 3))):
        assert (got[:rows, :columns] == p[:rows, :columns]).all()
        assert (got[..., 0] == p[..., 0]).all()
    rgb = progressive_jpeg.pixels(image)
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    # one block by the definition of the transform
    block = np.zeros(64)
    block[progressive_jpeg.ZIGZAG] = image.coefficients[0][0, 0] * 3
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, 1 / np.sqrt(2), 1) / 2
    luma = basis @ block.reshape(8, 8) @ basis.T + 128
    chroma = [progressive_jpeg.IDCT.T @ np.bincount(progressive_jpeg.ZIGZAG, image.coefficients[c][0, 0] * 3.0, 64) for c in (1, 2)]
    expected = np.clip(np.rint(luma[0, 0]), 0, 255) + 1.402 * np.clip(np.rint(chroma[1][0] + 128) - 128, -128, 127)
    assert abs(int(rgb[0, 0, 0]) - np.clip(np.rint(expected), 0, 255)) <= 1


def test_jpeg_columns(spark):
    texts = [(1, "abc"), (2, ""), (3, None), (4, "é" * 100_000), (5, "abc")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("feature", F.lit("x"))
    out = {r["doc_id"]: r for r in progressive_jpeg.store_texts(docs).collect()}
    for doc_id, text in texts:
        raw = (text or "").encode()
        payload = raw + b" " * ((-len(raw) % 192) or (0 if raw else 192))
        r = out[doc_id]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert out[1][1:] == out[5][1:] and out[2][1:] == out[3][1:]
    media = progressive_jpeg.store_texts(docs.where("doc_id < 3"), keep_media=True)
    broken = spark.createDataFrame([(8, None), (9, bytearray(b"no"))], "doc_id long, media binary")
    rgb = {r["doc_id"]: r for r in progressive_jpeg.rgb_tensors(media.unionByName(broken)).collect()}
    assert (rgb[1]["height"], rgb[1]["width"], len(rgb[1]["rgb"])) == (8, 8, 192) and rgb[8]["rgb"] is None and rgb[9]["height"] is None
    assert progressive_jpeg.store_texts(docs.limit(0)).count() == 0


# --- quality ---------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) for _ in range(300)]
    bad = [" ".join(rng.choice(["ALPHA!!", "BETA!!", "win", "$$$"]) for _ in range(30)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate([x for p in zip(good, bad) for x in p])]
    docs = spark.createDataFrame([*rows, (9000, ""), (9001, None), (9002, "beta " * 40_000), (None, "alpha")], "doc_id long, text string").withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 1) for i, _ in rows] + [(9000, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_ftrl.fit(docs, labels)
    out = {r["doc_id"]: r for r in quality_ftrl.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(out[i]["held_out"] for i in held) and not out[None]["held_out"]
    assert all(out[i]["predicted"] == int(i % 2 == 0) for i in held)
    assert out[9000]["score"] == out[9001]["score"] and 0 <= out[9000]["score"] <= 1
    assert out[9002]["predicted"] == 1
    kept = {r["doc_id"] for r in quality_ftrl.keep_good(docs, model).collect()}
    assert {i for i in kept if i is not None and i < 9000} == {i for i, _ in rows if i % 2 == 0}
    none = quality_ftrl.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_ftrl.score(docs, none).collect()} == {0.5}
    assert quality_ftrl.score(docs.limit(0), model).count() == 0


def test_hashes_do_not_depend_on_neighbours():
    a, b = b"one two, two three", b"  x\ty!!"
    pa, na = quality_ftrl.hashed([a])
    pb, nb = quality_ftrl.hashed([b])
    both, n = quality_ftrl.hashed([a, b"", b])
    assert list(n) == [na[0], 0, nb[0]] and list(both) == [*pa, *pb]


# --- chat ------------------------------------------------------------------------------------------


def test_preference_pairs(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 1, "assistant", "bad"), (1, "chosen", 2, "user", "ok"),
        (2, "chosen", None, None, None), (2, "rejected", None, "", ""), (3, "chosen", 0, "user", "same"), (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same"),
        (None, "chosen", 0, "user", "x"), (4, "other", 0, "user", "x"), (5, "rejected", 1, "assistant", "only"),
    ]
    frame = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumn("part", F.lit(1))
    out = preference_chat.format_pairs(frame)
    rows = {(r["pair_id"], r["part"], r["turn"], r["place"]): (r["body"], r["mask"]) for r in out.collect()}
    end = preference_chat.END
    assert rows == {
        (1, "prompt", 0, 0): ("hi" + end, 0), (1, "chosen", 1, 1): ("good" + end, 1), (1, "rejected", 1, 1): ("bad" + end, 1), (1, "chosen", 2, 2): ("ok" + end, 0),
        (2, "prompt", None, 0): (end, 0), (3, "prompt", 0, 0): ("same" + end, 0), (3, "chosen", 0, 1): ("same" + end, 0), (5, "rejected", 1, 0): ("only" + end, 1),
    }
    whole = {r["pair_id"]: r for r in preference_chat.records(out).collect()}
    r = whole[1]
    assert r["prompt"] == "<|im_start|>user\nhi" + end
    (span,) = r["chosen_learnt"]
    assert r["chosen"][span["start"] : span["end"]] == "good" + end
    assert preference_chat.format_pairs(frame.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 1_000_000])
def test_pairs_by_place_equal_a_plain_version(spark, chunk):
    """Turn numbers that differ between the sides, are negative or missing; repeated turns; a very long conversation."""
    rng = random.Random(12)
    turns = []
    for pair in range(25):
        shared = [(rng.choice(["user", "assistant"]), f"t{k}") for k in range(rng.randint(0, 5))]
        for side in ("chosen", "rejected"):
            at = rng.randint(-3, 3)
            for role, text in shared + [(rng.choice(["user", "assistant"]), rng.choice("ab")) for _ in range(rng.randint(0, 3))]:
                turns.append((pair, side, at, role, text))
                at += rng.randint(1, 5)
    turns += [(50, s, 2 * k + (s == "chosen"), "user", f"turn {k}") for s in ("chosen", "rejected") for k in range(300)] + [(50, "chosen", 10_000, "assistant", "end")]
    turns += [(51, s, t, "user", "x") for s in ("chosen", "rejected") for t in (None, 0, 0, 1)] + [(51, "rejected", 1, "user", "x")]
    expected = {}
    for pair in {t[0] for t in turns}:
        sides = [[(r, x) for _, _, _, r, x in sorted((t for t in turns if t[:2] == (pair, s)), key=lambda t: (t[2] is not None, t[2] or 0, t[3], t[4]))] for s in ("chosen", "rejected")]
        same = 0
        while same < min(map(len, sides)) and sides[0][same] == sides[1][same]:
            same += 1
        text = lambda t: (f"<|im_start|>{t[0]}\n", f"{t[1]}<|im_end|>\n")
        for place in range(max(map(len, sides))):
            if place < same:
                expected[pair, place] = ("".join(text(sides[0][place])), *[None] * 6)
            else:
                expected[pair, place] = (None, *(x for side in sides for x in ((*text(side[place]), int(side[place][0] == "assistant")) if place < len(side) else [None] * 3)))
    frame = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").repartition(7)
    assert {(r[0], r[1]): tuple(r[2:]) for r in preference_chat.paired(frame, chunk).collect()} == expected
    assert sum(1 for k, v in expected.items() if k[0] == 50 and v[0]) == 300


def test_swapped_endings(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (None, 0, "user", "x")]
    pairs = preference_chat.swapped_endings(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r["pair_id"], r["side"], r["turn"], r["text"]) for r in pairs.collect())
    assert got == [(1, "chosen", 0, "a"), (1, "chosen", 1, "b"), (1, "rejected", 0, "a"), (1, "rejected", 1, "d"), (2, "chosen", 0, "c"), (2, "chosen", 1, "d"), (2, "rejected", 0, "c")]


# --- decontamination -------------------------------------------------------------------------------


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [(1, f"x, ONE two-three four five six seven eight nine ten y {item}! z"), (2, "short ITEM here"), (3, None), (4, ""), (5, "one two three"), (2, "short ITEM here"), (None, item), (6, "word " * 20_000 + item)], "doc_id long, text string"
    ).withColumn("words", F.lit(1)).withColumn("_spans", F.lit(2))
    bench = spark.createDataFrame([(10, item), (9, "short item"), (8, None), (7, "!!"), (11, item)], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        out = defaultdict(list)
        for r in decontaminate.contamination(docs, bench, broadcast_windows=limit).collect():
            out[r["doc_id"]].append(r)
        assert (out[1][0]["n_words"], out[1][0]["n_hit"], out[1][0]["n_items"]) == (24, 21, 2)
        assert out[1][0]["items_sha256"] == hashlib.sha256(b"10,11").hexdigest()
        assert [r["n_hit"] for r in out[2]] == [2, 2] and out[2][0]["n_items"] == 1
        assert not out[3][0]["contaminated"] and out[4][0]["n_words"] == 0 and out[5][0]["n_hit"] == 0
        assert out[None][0]["n_hit"] == 11 and out[6][0]["n_hit"] == 11
    kept = {r["doc_id"]: r for r in decontaminate.remove_hits(docs, bench).collect()}
    assert kept[1]["text"] == "x, y z" and kept[2]["text"] == "here" and kept[3]["text"] is None and kept[5]["text"] == "one two three"
    assert kept[1]["_spans"] == 2
    assert decontaminate.remove_hits(docs, bench, drop_documents=True).where("doc_id IN (1, 2, 6)").isEmpty()
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.contamination(docs.limit(0), bench).isEmpty()


# --- repeated bytes and words ----------------------------------------------------------------------


def test_equal_windows_have_equal_minimisers():
    rng = np.random.default_rng(5)
    units = rng.integers(1, 2**62, 4000).astype(np.uint64)
    units[3000:3300] = units[100:400]
    a, first, n = super_kmers(units, 50, 8)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and n.sum() == len(units) - 49
    at = np.repeat(a, n)
    for i in range(0, 250):
        assert at[100 + i] == at[3000 + i]


def test_compare_against_all_windows():
    rng = random.Random(4)
    for trial in range(40):
        length = rng.choice([5, 20, 130, 200])
        base = bytes(rng.choice(b"ab") if trial % 2 else rng.randrange(97, 123) for _ in range(rng.randint(1, 900)))
        strings = []
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(base))
            x = bytearray(base[at : at + rng.randint(0, 600)])
            if x and rng.random() < 0.5:
                x[rng.randrange(len(x))] = 120
            strings.append(bytes(x))
        count, times = defaultdict(int), np.array([rng.choice([1, 1, 1, 2]) for _ in strings])
        for s, k in zip(strings, times):
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] += k
        got = bwt_repeats.compare(strings, times, None, "anywhere", length)
        assert [list(g) for g in got] == [[count[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


def test_boundaries_are_extended_without_passing_over_all_rows_in_each_round(monkeypatch):
    rng = np.random.default_rng(3)
    passage = rng.integers(1, 27, 400)
    text = np.append(np.concatenate([np.append(passage, rng.integers(1, 27, 20)) for _ in range(30)]), 0).astype(np.uint16)
    calls = {"argsort": 0, "cumsum": 0}

    def counted(name):
        plain = getattr(np, name)

        def run(x, *args, **settings):
            calls[name] += len(x) == len(text)
            return plain(x, *args, **settings)

        return run

    for name in calls:
        monkeypatch.setattr(np, name, counted(name))
    order = bwt_repeats.suffix_order(text)
    found = bwt_repeats.boundaries(text[order - 1], bwt_repeats.LENGTH)
    assert calls["argsort"] <= 5 and calls["cumsum"] <= 40
    # rows with no boundary between them start with the same 200 bytes, and no others do
    own = {}
    for row, group in zip(order.tolist(), np.cumsum(found).tolist()):
        if row <= len(text) - bwt_repeats.LENGTH:
            own.setdefault(text[row : row + bwt_repeats.LENGTH].tobytes(), set()).add(group)
    assert all(len(x) == 1 for x in own.values()) and len(set.union(*own.values())) == len(own)


def corpus():
    """Copies, passages in many contexts, repeats within one text, edges, nulls."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, twice, long_line = prose(70), prose(55), prose(120)
    rows = [(i, f"{prose(rng.randint(0, 80))} {shared}\n{prose(rng.randint(0, 60))}") for i in range(60)]
    rows += [(100 + i, long_line) for i in range(20)]
    rows += [(200 + i, long_line.replace(" ", "  ", 1) + " " + prose(3)) for i in range(5)]
    rows += [(300, f"{twice} x {twice}"), (301, "a" * 1500), (302, "b " * 130), (303, None), (304, ""), (305, prose(49)), (306, prose(8000) + " " + shared), (307, "é" * 150 + shared), (308, "é" * 150), (308, "é" * 150), (None, shared), (309, twice)]
    rng.shuffle(rows)
    return rows


def brute_bytes(rows):
    count = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 199):
            count[b[i : i + 200]] += 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [1 << 18, 4000, 1])
def test_repeats_against_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("_spans", F.lit(2)).repartition(7)
    assert ordered(map(tuple, bwt_repeats.remove_repeats(docs, hot=hot).collect())) == ordered(brute_bytes(rows))
    assert ordered(map(tuple, window_dedup.remove_repeats(docs, hot=hot).collect())) == ordered(brute_words(rows))


def test_repeats_small_tables(spark):
    docs = spark.createDataFrame(corpus()[:1], "doc_id long, text string")
    assert bwt_repeats.remove_repeats(docs.limit(0)).isEmpty() and window_dedup.remove_repeats(docs.limit(0)).isEmpty()
    assert bwt_repeats.remove_repeats(docs, keep=True).count() == 1
    assert window_dedup.remove_repeats(docs, keep=True).first()["n_removed"] == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_built_to_collide_are_told_apart(spark, n):
    """Any sum of powers of an odd base modulo 2 ** 64 is alike for such a word and its complement."""
    side = " ".join(f"w{i}" for i in range(60))
    left, right = side[: side.index(" w30")], side[side.index("w30") :]
    one, other = thue_morse(n), thue_morse(n, "b", "a")
    assert len(set(window_dedup.word_hashes(f"{one} {other}".encode()).tolist())) == 2
    for first, second in ((one, other), (other, one)):
        rows = [(1, f"{left} {first} {right}"), (2, f"{left} {second} {right}"), (3, f"{left} {second} {right}")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert ordered(map(tuple, window_dedup.remove_repeats(docs).collect())) == ordered(brute_words(rows))
        assert {r["doc_id"]: r["n_removed"] for r in window_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 61}
        assert ordered(map(tuple, bwt_repeats.remove_repeats(docs).collect())) == ordered(brute_bytes(rows))


def test_many_equal_rows(spark):
    """One id and text 300 times, among texts that have parts of it."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    rows = [(7, " ".join(base))] * 300 + [(i, " ".join([*base[i : i + 90], word()])) for i in range(3, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert ordered(map(tuple, bwt_repeats.remove_repeats(docs).collect())) == ordered(brute_bytes(rows))
    assert ordered(map(tuple, window_dedup.remove_repeats(docs).collect())) == ordered(brute_words(rows))


def brute_cut(text, gone):
    """text without the flagged words and the white space after each."""
    parts = re.findall(r"[^ \t-\r]+[ \t-\r]*", text)
    return text[: len(text) - len("".join(parts))] + "".join(x for x, g in zip(parts, gone) if not g)


def test_spans_of_repeated_rows_count_once(spark):
    """Very many rows of one id and one text: no row carries more spans than one text has."""
    from seqloom.llm.superkmers import ANYWHERE, SMALLER, repeated_spans

    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    docs = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(3, text), (9, "alone")], "doc_id long, text string")).repartition(8)
    for kind, repeats in ((bwt_repeats.BYTES, ANYWHERE), (window_dedup.WORDS, SMALLER)):
        once = repeated_spans(docs.distinct(), kind, repeats).where("id = 7").first()
        spans = repeated_spans(docs, kind, repeats)
        found = spans.where("id = 7").collect()
        assert len(found) == 1 and sorted(found[0]["spans"]) == sorted(once["spans"])
    out = window_dedup.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in out} == {(7, 120, 5000), (3, 0, 1), (9, 0, 1)}
    out = bwt_repeats.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {tuple(r) for r in out} == {(7, len(text), 5000), (3, len(text), 1), (9, 0, 1)}


def test_texts_without_repeats_keep_their_white_space(spark):
    rows = [(d, t, "x") for d, t in corpus() if d != 308]
    rows += [(400, " \n" + rows[0][1].replace(" ", "\t\n")), (401, rows[1][1] + "\r\n")]
    rows = [(*r, "x")[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string")
    out = window_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    first = {}
    for d, t, _ in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), d), d)
    expected = []
    for d, t, mark in rows:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone |= set(range(i, i + 50))
        expected.append((d, brute_cut(t, [i in gone for i in range(len(w))]) if gone else t, mark))
    assert ordered(map(tuple, out.collect())) == ordered(expected)


def test_long_texts_are_cut_into_pieces(monkeypatch, spark):
    from seqloom.llm import superkmers

    rows = [(1, " ".join(str(i % 700) for i in range(3000))), (2, " ".join(str(i % 700) for i in range(650, 900)))]
    expected = brute_words(rows)
    for piece in (64, 333):
        starts = []
        for _, t in rows:
            units, at, own = window_dedup.word_hashes(t.encode()), 0, []
            while at == 0 or at + 50 <= len(units):
                _, first, n = super_kmers(units[at : at + piece], 50, 8)
                own += [i for f, k in zip(first + at, n) for i in range(f, f + k)]
                at += piece - 50 + 1
            starts.append(own == list(range(len(units) - 49)))
        assert all(starts)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(map(tuple, window_dedup.remove_repeats(docs).collect())) == ordered(expected)
