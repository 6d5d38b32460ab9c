"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text's five-word shingles are labelled with their occurrence number. Each of `sketches` orders of hashes
picks the `size` smallest of them and keeps them in the order of the text; texts that agree in one such
sketch are candidates. The chance falls with both missing and reordered shingles, as edit similarity
does. A candidate pair counts if its words can be aligned with at most 0.2 * (words of the longer text)
edits; the alignment runs over a band of diagonals, whose cells are the bits of integers, and widens the band as needed.

Equal texts (words alike but for case and white space; told apart by 128-bit digests of their bytes) are one node from
the start, so groups of copies cost nothing later. Every pair of a bucket is settled:

1. Each node is aligned with the smallest nodes of its buckets (their leaders), the smallest leader first, the others, and some
   neighbours in a random order of its buckets, only where the two aren't of one class by then.
2. Buckets that still hold several classes compare all their other pairs in blocks of about `BLOCK_TEXTS` texts; a bucket of
   many texts is dealt over pairs of blocks, so none is one task. Sketches go first: the parities of a text's words and word pairs in
   some hundred places, of which two texts that can be aligned differ in no more than 2 or 4 places for each edit. Only texts that have a possible
   partner of another class in a block travel there, packed. Pairs that the sketches let through are aligned there, in one of
   the buckets that the two share, unless the block has linked their classes already, so a block gives fewer links than it has classes.
3. Buckets of more than `crowd` texts (a passage that unlike texts share) would need blocks by the square. Texts that can be aligned share one of their
   rarest word pairs (the first ones, if all but a fixed number that they must have in common are left out), so such texts meet
   in buckets by rare word pair instead, which go through step 2. No pair is lost in either way.
4. Edits of a text of few words leave it few shingles of five, or none. Texts of up to `SHORT` words and their possible partners therefore
   meet by rare word pair as well, whether or not they share a bucket: all of their pairs are found.

Classes are the connected components of the links.

Defined results: texts without words are one class; texts of fewer than five words have one shingle; rows
of one id and one text are in one class; the class id is the smallest doc_id in it, null only where all are
null, so it doesn't tell classes apart, but their labels (the digest of the text that stands for the class) do; texts of any length are sketched in pieces and compared whole; other columns don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import fresh, in_batches, partitions, settled, text_or_empty
from seqloom.llm.superkmers import ODD, Hashes, mixed
from seqloom.llm.window_dedup import normal, word_hashes

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 96
SIZE = 2
#: Shingles whose hashes are in memory at once.
PIECE = 1 << 12
BLOCK_TEXTS = 2048
BLOCK_WORDS = 1_000_000
CROWD = 8 * BLOCK_TEXTS
#: Neighbours that a text is compared with before all pairs of its buckets are.
BESIDE = 8
#: Places of the smallest parity sketches, and numbers of 64 places that are compared at once.
LEAST_BITS = 1024
PARITY_WORK = 1 << 21
#: Texts of up to so many words are found by their rarest word pairs too, as they have too few shingles of five.
SHORT = 40


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, number of its occurrence)."""
    order = np.argsort(shingles, kind="stable")
    own = shingles[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    number = np.empty(len(own), np.uint64)
    number[order] = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
    return mixed(shingles + number * ODD)


@functools.cache
def orders(sketches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A seed for each order of hashes, a factor that makes the order, and the row numbers."""
    seeds = mixed(np.arange(1, sketches + 1, dtype=np.uint64) * ODD)
    return seeds, ((seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None], np.arange(sketches)


def smallest(marked: np.ndarray, sketches: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and places of the `size` smallest hashes in each order, the smallest first."""
    _, factors, rows = orders(sketches)
    values = marked[None, :] * factors
    values ^= values >> np.uint32(15)
    values *= np.uint32(0x2C1B3C6D)
    values ^= values >> np.uint32(12)
    size = min(size, len(marked))
    best, places = np.empty((sketches, size), np.uint32), np.empty((sketches, size), np.int64)
    for k in range(size):
        places[:, k] = values.argmin(axis=1)
        best[:, k] = values[rows, places[:, k]]
        values[rows, places[:, k]] = np.uint32(0xFFFFFFFF)
    return best, places


def order_sketches(words: np.ndarray, sketches: int = SKETCHES, size: int = SIZE, width: int = WORDS) -> np.ndarray:
    """One bucket hash per order of hashes."""
    if not len(words):
        return np.empty(0, np.int64)
    shingles = Hashes(words).all(min(width, len(words)))
    marked = (labelled(shingles) >> np.uint64(32)).astype(np.uint32)
    best, places = smallest(marked[:PIECE], sketches, size)
    for at in range(PIECE, len(marked), PIECE):
        more, further = smallest(marked[at : at + PIECE], sketches, size)
        best, places = np.concatenate([best, more], axis=1), np.concatenate([places, further + at], axis=1)
        keep = np.argsort(best, axis=1, kind="stable")[:, :size]
        best, places = np.take_along_axis(best, keep, 1), np.take_along_axis(places, keep, 1)
    out = orders(sketches)[0]
    for column in np.sort(places, axis=1).T:  # in the order of the text
        out = mixed(out * ODD + shingles[column])
    return out.view(np.int64)


def within_band(a: list, b: list, band: int) -> bool:
    """Whether at most `band` insertions, deletions and replacements make b of a; a is not the shorter one, and longer than the band.

    A column of the table of edit distances is kept as its steps up and down, one bit for each of the 2 * band + 1 rows
    around the diagonal; all rows take part in the same few operations on integers. The rows move down with the columns.
    """
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    m, n, width = len(a), len(b), 2 * band + 1
    full = (1 << width) - 1
    up, down = full ^ ((1 << band) - 1), 0
    # the distance is followed along the lowest diagonal to the last row, and along that row to its end
    distance, most, mark = band, band + n - (m - band), 1 << (width - 1)
    for j, word in enumerate(b):
        match = places.get(word, 0)
        match = (match >> (j - band) if j >= band else match << (band - j)) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right_up, right_down = down | (full ^ (diagonal | up)), diagonal & up
        if j < m - band:
            distance += not diagonal & mark
        else:
            mark >>= 1
            distance += bool(right_up & mark) - bool(right_down & mark)
        if distance > most:
            return False
        diagonal >>= 1
        up, down = right_down | (full ^ (diagonal | right_up)), diagonal & right_up
    return distance <= band


def alignable(a: list, b: list, most: int) -> bool:
    """Whether at most `most` insertions, deletions and replacements make b of a."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    if len(a) <= most or a == b:
        return True
    # words that have no partner at all
    if len(a) - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    head = 0
    while head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    band = min(most, max(8, len(a) - len(b)))
    while True:
        if len(a) <= band or within_band(a, b, band):
            return True
        if band == most:
            return False
        band = min(most, 4 * band)


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    return alignable(a, b, int(np.floor((1 - similarity) * max(len(a), len(b)) + 1e-9)))


def compared_bytes(text: str) -> bytes:
    """What of a text is compared: its words, in lower case, with a space between them."""
    return normal(text.lower().encode())


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sketched(docs: DataFrame, sketches: int, size: int) -> DataFrame:
    """id, digest of the compared words, bucket hashes and number of words."""

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            data = [compared_bytes(x) for x in batch.column(1).to_pylist()]
            found = [order_sketches(word_hashes(x), sketches, size) for x in data]
            times = pa.array([x.count(b" ") + 1 if x else 0 for x in data], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in data], pa.binary()), pa.array(found, pa.list_(pa.int64())), times], ["id", "digest", "buckets", "n"])

    return docs.transform(in_batches, run, f"id {docs.schema['id'].dataType.simpleString()}, digest binary, buckets array<long>, n int")


def word_pool(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, its compared bytes and number of words, of the wanted nodes (id, digest, node); the texts are shuffled once."""

    def run(batches):
        for batch in batches:
            out = []
            for text, own, node in zip(*(c.to_pylist() for c in batch.columns)):
                data = compared_bytes(text)
                if digest(data) == own:
                    out.append((node, data, data.count(b" ") + 1 if data else 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.int32()))], ["node", "words", "n"])

    want = wanted.select(F.col("id").alias("own"), "digest", "node")
    rows = docs.join(want, F.col("id").eqNullSafe(F.col("own"))).select("text", "digest", "node")
    return rows.transform(in_batches, run, "node long, words binary, n int").dropDuplicates(["node"])


def verified(pairs: DataFrame, pool: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, leader) that can be aligned."""
    left = pairs.join(pool, "node").select("node", "leader", F.col("words").alias("own"))
    both = left.join(pool.select(F.col("node").alias("leader"), F.col("words").alias("other")), "leader").select("node", "leader", "own", "other")

    def run(batches):
        for batch in batches:
            same = [similar(a.split(), b.split(), similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["node", "leader"]).filter(pa.array(same, pa.bool_()))

    return both.transform(in_batches, run, "node long, leader long")


def short_hashes(data: bytes) -> np.ndarray:
    return (word_hashes(data) >> np.uint64(48)).astype("<u2")


def grams(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of (run of `width` words, number of its occurrence)."""
    if len(words) < width:
        return np.empty(0, np.int64)
    out = mixed(words.astype(np.uint64) + ODD)
    for k in range(1, width):
        out = mixed(out[:-1] * ODD + words[k:].astype(np.uint64))
    return labelled(out).view(np.int64)


def common_grams(words: int, similarity: float, width: int) -> int:
    """How many runs a text has at least in common with any that isn't shorter and can be aligned with it: an edit breaks `width` of them."""
    return max(1, int(np.ceil(words - (width - 1) - width * (1 - similarity) * words - 1e-6)))


def parity_bits(words: int) -> int:
    """Places of a text's parity sketch: several for each word, so that few differences fall together."""
    bits = LEAST_BITS
    while bits < 4 * words:
        bits *= 4
    return bits


def parity_sketch(words: np.ndarray) -> bytes:
    """For the text's words and for its word pairs: whether each place has an odd number of them. Two texts' sketches differ in no more places than the texts in words (or pairs)."""
    bits = parity_bits(len(words))
    odd = [np.bincount(grams(words, width) & (bits - 1), minlength=bits).astype(np.uint8) & 1 for width in (1, 2)]
    return np.packbits(np.concatenate(odd), bitorder="little").tobytes()


def folded(sketches: np.ndarray, bits: int) -> np.ndarray:
    """Sketches (a row of 64-bit numbers each) made anew with fewer places."""
    kinds = sketches.reshape(len(sketches), 2, -1)
    return np.bitwise_xor.reduce(kinds.reshape(len(sketches), 2, -1, bits // 64), axis=2)


def maybe_alignable(left: list[tuple], right: list[tuple], similarity: float) -> np.ndarray:
    """Flags of the pairs of texts of different labels that may be alignable; all that are have theirs set. Rows: label, number of words, parity sketch."""
    sides, by_size = (left, right), []
    for side in sides:
        places: dict[int, list[int]] = {}
        for i, row in enumerate(side):
            places.setdefault(parity_bits(row[1]), []).append(i)
        by_size.append({bits: np.array(at) for bits, at in places.items()})
    label, n = ([np.array([row[k] for row in side]) for side in sides] for k in (0, 1))
    out = np.zeros((len(left), len(right)), bool)
    for a_bits, a in by_size[0].items():
        for b_bits, b in by_size[1].items():
            # texts of sizes that are farther apart differ too much in length
            if max(a_bits, b_bits) > 4 * min(a_bits, b_bits):
                continue
            bits = min(a_bits, b_bits)
            own, other = (folded(np.frombuffer(b"".join(side[i][2] for i in at), "<u8").reshape(len(at), -1), bits) for side, at in zip(sides, (a, b)))
            step = max(1, PARITY_WORK // (len(b) * bits // 64))
            for k in range(0, len(a), step):
                mine = a[k : k + step]
                longer = np.maximum(n[0][mine][:, None], n[1][b][None, :])
                most = np.floor((1 - similarity) * longer + 1e-9)
                ok = (label[0][mine][:, None] != label[1][b][None, :]) & (np.abs(n[0][mine][:, None] - n[1][b][None, :]) <= most)
                for kind in (0, 1):
                    i, j = np.nonzero(ok)
                    differ = np.bitwise_count(own[k + i, kind] ^ other[j, kind]).sum(axis=1, dtype=np.int64)
                    # a replaced word changes two of the words and four of the pairs
                    ok[i, j] = differ <= (2 + 2 * kind) * most[i, j]
                out[np.ix_(mine, b)] = ok
    return out


def involved(left: list[tuple], right: list[tuple] | None, similarity: float) -> tuple[set[int], set[int]]:
    """Places in left and right (None: left itself) of the texts that may be alignable with one of another label."""
    ok = maybe_alignable(left, left if right is None else right, similarity)
    return set(np.flatnonzero(ok.any(axis=1)).tolist()), set(np.flatnonzero(ok.any(axis=0)).tolist())


def in_runs(batches, keys: int):
    """key (the first columns) and the other columns of each run of rows that agree in it."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != last:
                if held:
                    yield last, held
                held, last = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield last, held


def owned(key: int, own: np.ndarray, others: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Which of the pairs of a node with others are for the bucket `key`: of the sketches in which a pair agrees, the first one from a place that depends on the pair has it."""
    agree, n = others == own, len(own)
    start = (pair.astype(np.uint64) * ODD >> np.uint64(40)).astype(np.int64) % n
    turned = np.take_along_axis(agree, (start[:, None] + np.arange(n)) % n, 1)
    return own[(start + turned.argmax(axis=1)) % n] == key


def block_links(key: int, held: list[tuple], similarity: float) -> list[tuple[int, int]]:
    """Links between nodes of different labels that join all labels which the block's alignable pairs join. held: own (which of the two blocks), node, label, n, parity, packed words, buckets, slots (the node's bucket by each sketch, or none)."""
    left = [i for i, r in enumerate(held) if r[0] == held[0][0]]
    right = [i for i, r in enumerate(held) if r[0] != held[0][0]] or left
    ok = maybe_alignable([held[i][2:5] for i in left], [held[i][2:5] for i in right], similarity)
    if right is left:
        ok &= np.tri(len(left), k=-1, dtype=bool)
    buckets = [r[6] and frozenset(r[6]) for r in held]
    parts: dict[int, list[bytes]] = {}
    # labels that links have joined so far have one number
    label = np.array([r[2] for r in held])
    across, links = label[right], []
    slots = np.array([r[7] for r in held], np.int64)
    node = np.array([r[1] for r in held])
    for row in range(len(left)):
        i = left[row]
        open_ = ok[row] & (across != label[i])
        if slots.shape[1] and open_.any():
            at = np.flatnonzero(open_)
            open_[at] = owned(key, slots[i], slots[np.array(right)[at]], node[i] ^ node[np.array(right)[at]])
        while open_.any():
            at = int(open_.argmax())
            open_[at] = False
            j = right[at]
            if buckets[i] and buckets[i].isdisjoint(buckets[j]):
                continue
            for k in (i, j):
                if k not in parts:
                    parts[k] = zlib.decompress(held[k][5]).split()
            if similar(parts[i], parts[j], similarity):
                links.append((max(held[i][1], held[j][1]), min(held[i][1], held[j][1])))
                label[label == label[j]] = label[i]
                across = label[right]
                open_ &= across != label[i]
    return links


def links_in_blocks(member: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links (node, leader) between nodes of different labels that share a key of member (key, node), enough to join all labels that such pairs join. known: node, label, n (words), packed (its words), parity (its sketch), buckets (of which two nodes must share one, if there are any)."""
    labelled_member = member.join(known.select("node", "n", "label"), "node")
    sizes = labelled_member.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("w"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    parts = F.ceil(F.greatest(F.col("c") / BLOCK_TEXTS, F.col("w") / BLOCK_WORDS)).cast("int")
    inside = settled(member.join(sizes.select("key", parts.alias("parts")), "key"))
    rows = inside.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node")

    def sift(batches):
        for key, held in in_runs(batches, 3):
            first = [r for r in held if r[0] == held[0][0]]
            second = [r for r in held if r[0] != held[0][0]]
            # two blocks, one of which has no text, hold no pair
            if key[1] != key[2] and not second:
                continue
            some, more = involved([r[2:] for r in first], [r[2:] for r in second] or None, similarity)
            left = [first[i] for i in (some | more if not second else some)] + [second[i] for i in (more if second else ())]
            columns = [pa.array([x] * len(left), t) for x, t in zip(key, (pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[0] for r in left], pa.int32()), pa.array([r[1] for r in left], pa.int64())], ["key", "lo", "hi", "own", "node"])

    # first sketches alone: few of a bucket's texts may be alignable with one of another class, and only theirs travel
    n = partitions(rows.sparkSession)
    sketched = rows.join(known.select("node", "label", "n", "parity"), "node").select("key", "lo", "hi", "own", "node", "label", "n", "parity")
    sketched = sketched.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own", "node")
    rows = settled(sketched.transform(in_batches, sift, "key long, lo int, hi int, own int, node long"))
    rows = rows.join(known, "node").select("key", "lo", "hi", "own", "node", "label", "n", "parity", "packed", "buckets", "slots")

    def run(batches):
        for key, held in in_runs(batches, 3):
            if links := block_links(key[0], held, similarity):
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["node", "leader"])

    # by number: the rows are few and small, their comparisons are not
    dealt = rows.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own", "node")
    return dealt.transform(in_batches, run, "node long, leader long").distinct()


def rare_pairs(known: DataFrame, similarity: float) -> DataFrame:
    """key (a run of words) and node, for each node (node, packed): its rarest runs, all but as many as it must have in common with a text that it can be aligned with, less one."""
    width = 2 if similarity >= 0.75 else 1

    def run(batches):
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            words = [short_hashes(zlib.decompress(w)) for w in batch.column(1).to_pylist()]
            found = [grams(w, width) for w in words]
            times = np.array([len(g) for g in found], np.int64)
            need = np.array([common_grams(len(w), similarity, width) for w in words], np.int64)
            node = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, times)), pa.array(np.repeat(need, times)), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["node", "need", "key"])

    rows = settled(known.select("node", "packed").transform(in_batches, run, "node long, need long, key long"))
    often = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    # runs that one text alone has lead to no pair; they count as the rarest
    order = Window.partitionBy("node").orderBy(F.col("c").desc(), "key")
    return rows.join(often, "key").withColumn("place", F.row_number().over(order)).where("place >= need").select("key", "node")


def compared(nodes: DataFrame, labels: DataFrame, pool: DataFrame) -> DataFrame:
    """node, label, packed (its words), n (their number) and parity (its sketch) of the nodes."""

    def run(batches):
        for batch in batches:
            words = batch.column(2).to_pylist()
            packed, parity = pa.array([zlib.compress(x, 1) for x in words], pa.binary()), pa.array([parity_sketch(short_hashes(x)) for x in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, batch.column(3), parity], ["node", "label", "packed", "n", "parity"])

    wanted = labels.select("node", "label").join(nodes, "node").join(pool, "node").select("node", "label", "words", "n")
    return settled(wanted.transform(in_batches, run, "node long, label long, packed binary, n int, parity binary"))


def anywhere(known: DataFrame) -> DataFrame:
    """known with no buckets that two nodes would have to share, and no slots."""
    return known.withColumns({c: F.array().cast("array<bigint>") for c in ("buckets", "slots")})


def open_links(labels: DataFrame, member: DataFrame, pool: DataFrame, similarity: float, crowd: int, slots: DataFrame | None = None) -> DataFrame:
    """Links (node, leader) that join all classes (node, label) which alignable nodes of one bucket (bucket, node) join. Buckets of two nodes have been settled before. With slots (node, slots) a pair is aligned in one bucket alone."""
    inside = settled(member.select("bucket", "node").join(labels.select("node", "label"), "node"))
    several = inside.groupBy("bucket").agg(F.count("*").alias("c"), F.min("label").alias("a"), F.max("label").alias("b")).where("c > 2 AND a <> b")
    inside = settled(inside.join(several.select("bucket", "c"), "bucket").select(F.col("bucket").alias("key"), "node", "label", "c"))
    known = compared(inside.select("node").distinct(), labels, pool)
    placed = anywhere(known) if slots is None else anywhere(known).drop("slots").join(slots, "node")
    links = links_in_blocks(inside.where(F.col("c") <= crowd).select("key", "node"), placed, similarity)
    crowded = inside.where(F.col("c") > crowd).select("key", "node")
    if not crowded.isEmpty():
        some = settled(anywhere(known).drop("buckets").join(crowded.groupBy("node").agg(F.collect_list("key").alias("buckets")), "node"))
        links = links.unionByName(links_in_blocks(rare_pairs(some, similarity), some, similarity))
    return links


def longest_partner(similarity: float) -> int:
    """Words of the longest text that is alignable with one of SHORT words."""
    return int(np.floor(SHORT / similarity + 1e-9))


def short_links(labels: DataFrame, pool: DataFrame, similarity: float) -> DataFrame:
    """Links (node, leader) that join all classes which alignable texts of up to longest_partner words join, whatever their buckets. One word is alignable with itself alone."""
    known = compared(pool.where(F.col("n").between(2, longest_partner(similarity))).select("node"), labels, pool)
    return links_in_blocks(rare_pairs(known, similarity), anywhere(known), similarity)


def rooted(links: DataFrame) -> DataFrame:
    """node and root of links (node, leader) in which each node has one leader, smaller than itself: leaders of leaders until none is left."""
    tree = links.select("node", F.col("leader").alias("root"))
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("above"))
        tree = settled(tree.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if tree.where("moved").isEmpty():
            return tree.select("node", "root")
        tree = tree.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) of all nodes of edges (u, v), by large and small stars."""
    edges = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours of a node go to the smallest of its neighbourhood
        least = settled(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = settled(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours go to the smallest of them
        least = settled(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = settled(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # the same edges: as many, and none that is new
        stable = small.count() == edges.count() and small.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if stable:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def settled_classes(docs: DataFrame, *, id_column: str, text_column: str, similarity: float = SIMILARITY, sketches: int = SKETCHES, size: int = SIZE, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """id and digest of each row of docs; and for each digest class_id (smallest id of its class), label (the digest of the text of that id that stands for the class) and texts (different texts in the class)."""
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    seen = settled(sketched(rows, sketches, size))
    # nodes are numbers, for the sake of joins and sums; written once, so that they stay. Equal texts have equal buckets
    texts = settled(seen.groupBy("digest").agg(F.min("id").alias("id"), F.first("buckets").alias("buckets"), F.first("n").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    member = texts.select("node", F.explode("buckets").alias("bucket"))
    full = settled(member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1"))
    member = settled(member.join(full, "bucket"))
    # short texts meet by rare word pairs too, below
    short = texts.where(F.col("n").between(2, longest_partner(similarity))).select("node")
    slots = texts.select("node", F.col("buckets").alias("slots"))
    texts = texts.drop("buckets", "n")
    candidates = settled(member.where("node <> leader").select("node", "leader").distinct())
    pool = settled(word_pool(rows, texts.join(member.select("node").unionByName(short).distinct(), "node")))
    # the smallest leader first; the rest only where that hasn't made them one class already
    links = settled(verified(candidates.groupBy("node").agg(F.min("leader").alias("leader")), pool, similarity))
    roots = settled(rooted(links))
    mine = roots.select("node", F.col("root").alias("own"))
    lead = roots.select(F.col("node").alias("leader"), F.col("root").alias("lead"))

    def apart(pairs: DataFrame) -> DataFrame:
        """Those rows (node, leader, ...) whose two aren't in one class so far."""
        both = pairs.join(mine, "node", "left").join(lead, "leader", "left")
        return both.where(F.coalesce("own", F.col("node")) != F.coalesce("lead", F.col("leader"))).drop("own", "lead")

    # all other leaders of those that aren't of their class, and some neighbours in a random order of each bucket: what these join needn't be
    # found again in every block
    tried = candidates.groupBy("node").agg(F.min("leader").alias("leader"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK_TEXTS)).alias("part")
    beside = member.select("bucket", "node", part).withColumn("next", F.lead("node").over(Window.partitionBy("bucket", "part").orderBy(F.xxhash64("node", "bucket")))).where("next IS NOT NULL")
    beside = beside.select(F.greatest("node", "next").alias("node"), F.least("node", "next").alias("leader")).distinct()
    beside = beside.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "leader")))).where(F.col("place") <= BESIDE).drop("place")
    pairs = settled(apart(candidates.unionByName(beside).distinct()).join(tried, ["node", "leader"], "left_anti"))
    found = settled(verified(pairs, pool, similarity))

    def between(links: DataFrame) -> DataFrame:
        """The classes u and v that links (node, leader) join."""
        both = links.join(mine, "node", "left").join(lead, "leader", "left")
        return both.select(F.coalesce("own", F.col("node")).alias("u"), F.coalesce("lead", F.col("leader")).alias("v")).where("u <> v")

    # buckets that still hold several classes: all of their other pairs. Classes needn't be joined in full for that
    up = settled(between(found).groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("leader")))
    above = rooted(up).select(F.col("node").alias("root"), F.col("root").alias("label"))
    labels = texts.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.col("node"))).join(above, "root", "left")
    labels = settled(labels.select("node", "id", "digest", "root", F.coalesce("label", F.col("root")).alias("label")))
    more = settled(open_links(labels, member, pool, similarity, crowd, slots).unionByName(short_links(labels, pool, similarity)))
    # classes that these links join
    joined = components(between(found.unionByName(more))).select(F.col("node").alias("root"), F.col("label").alias("least"))
    labels = labels.select("node", "id", "digest", "root").join(joined, "root", "left")
    labels = settled(labels.select("id", "digest", F.coalesce("least", F.col("root")).alias("class")))
    first = F.min(F.struct(F.col("id").isNull(), "id", "digest"))["digest"]
    smallest = settled(labels.groupBy("class").agg(F.min("id").alias("class_id"), first.alias("label"), F.count("*").alias("texts")))
    return seen.select("id", "digest"), settled(labels.join(smallest, "class").select("digest", "class_id", "label", "texts"))


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """id, class_id, label (its class's own, as several classes may have one class_id), texts (different texts in its class) and kept (whether it is the class's first) of each row."""
    rows, known = settled_classes(docs, id_column=id_column, text_column=text_column, **options)
    kept = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("label"))
    return rows.join(known, "digest").select(F.col("id").alias(id_column), "class_id", F.lower(F.hex("label")).alias("label"), "texts", kept.alias("kept"))


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the smallest id and, among different texts of that id, of the smallest digest."""
    own, group = fresh(docs, "_digest"), fresh(docs, "_class")
    _, known = settled_classes(docs, id_column=id_column, text_column=text_column, **options)
    known = known.where("digest = label").select(F.col("digest").alias(own), F.col("class_id").alias(group))
    place, width = docs.columns.index(text_column), len(docs.columns)

    def run(batches):
        for batch in batches:
            found = pa.array([digest(compared_bytes(x or "")) for x in batch.column(place).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], found], [*batch.schema.names[:width], own])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{own}` binary"
    kept = docs.transform(in_batches, run, schema).join(known, own).where(F.col(id_column).eqNullSafe(F.col(group)))
    # rows of one id and one text are one document
    return kept.dropDuplicates([own]).select(*docs.columns)
