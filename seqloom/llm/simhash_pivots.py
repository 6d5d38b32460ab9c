"""Near-duplicate documents by SimHash, pairs pruned by tables of distances to pivots.

A text's 3-word shingles (repeats included) are hashed with XXH64; a fingerprint's bit is set if it is set in over half of the
hashes. Fingerprints that differ in at most `RADIUS` bits are linked; a document's component_id is the smallest id that links lead to.

Equal fingerprints are one node, so copies cost nothing later. How links are found:

1. The Hamming distances of a fingerprint to `PIVOTS` reference fingerprints are its coordinates. By the triangle inequality a
   pair's largest coordinate difference isn't above its distance, so pairs beyond `RADIUS` in any coordinate are discarded by
   the table alone; what survives all pivots is verified.
2. Random pivots tell how far apart two fingerprints are but are no key that rows could be dealt by: every coordinate is near
   32, and 0.35 of all pairs agree in one within `RADIUS`. So the pairs that the tables are asked about meet by pigeonholes: of 5
   segments of the bits, a linked pair agrees in 3, which gives 10 keys of 38 or 39 bits. Keys of more than `BLOCK` fingerprints
   are cut once more by the bits that the key leaves, in the same way (2 of 4 parts agree), and what is still larger is dealt over
   pairs of blocks. No pair is lost in any of these, and no task gets more than two blocks of one key.
3. A block gives the smallest node of each of its nodes' groups rather than all pairs of a dense group. Components are joined by
   large and small stars.

Defined results: null and empty texts and texts without words have the fingerprint zero, which links like any other; texts of
fewer words than a shingle are one shingle; texts of any length are hashed whole, in pieces; rows of one id have their own
fingerprints; null ids get a component too, whose id is the smallest of those that aren't null, and null where there is none;
other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches, partitions, settled, text_or_empty
from seqloom.llm.order_minhash import components
from seqloom.llm.superkmers import ODD, mixed

WORDS = 3
SEED = 42
RADIUS = 2
PIVOTS = 32
SEGMENTS = 5
#: Parts of the bits that a key of segments leaves.
CUTS = 4
#: Fingerprints of one key that are compared in one place.
BLOCK = 2048
#: Hashes whose bits are counted at once, and pairs that are held before groups are joined.
PIECE = 1 << 15
PAIRS = 1 << 20


def shingle_hashes(words: list[bytes], width: int = WORDS) -> list[int]:
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    return [xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(width))))]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes that begins at one of starts."""
    sizes = np.diff(starts, append=len(hashes))
    counts = np.zeros((len(starts), 64), np.int64)
    for at in range(0, len(hashes), PIECE):
        bits = np.unpackbits(hashes[at : at + PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(starts, [at, at + len(bits) - 1], "right") - 1
        counts[first : last + 1] += np.add.reduceat(bits, np.maximum(starts[first : last + 1] - at, 0), axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """One unsigned 64-bit number for each text."""
    out, held, owners, starts, n = np.zeros(len(texts), np.uint64), [], [], [], 0

    def close() -> None:
        if held:
            out[owners] = majority(np.concatenate(held), np.array(starts, np.int64))

    for i, text in enumerate(texts):
        # A-Z and ASCII white space alone are what these two know of bytes
        if found := shingle_hashes((text or "").encode().lower().split()):
            held.append(np.array(found, np.uint64))
            owners.append(i)
            starts.append(n)
            n += len(found)
            if n >= PIECE:
                close()
                held, owners, starts, n = [], [], [], 0
    close()
    return out


@functools.cache
def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * ODD)


def distance_table(prints: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Hamming distances of fingerprints to each pivot; a row for each pivot."""
    return np.bitwise_count(prints[None, :] ^ pivots(n)[:, None]).astype(np.int8)


def close_pairs(prints: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that differ in at most radius bits: discarded pivot by pivot, then verified."""
    for own in table:
        keep = np.abs(own[i] - own[j]) <= radius
        i, j = i[keep], j[keep]
        if not len(i):
            return i, j
    keep = np.bitwise_count(prints[i] ^ prints[j]) <= radius
    return i[keep], j[keep]


def joined(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's group once the groups of all pairs (i, j) are joined."""
    while len(i):
        a, b = group[i], group[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        while (group[group] != group).any():
            group = group[group]
    return group


def groups_in_runs(run: np.ndarray, side: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the first place of its group of linked ones. Pairs are those of one run (rows of a run stand together) that are of different sides, or both of side 0."""
    table, group = distance_table(prints), np.arange(len(prints))
    held, n = [], 0
    at, step = np.arange(len(prints)), 1
    while True:
        at = at[at + step < len(prints)]
        at = at[run[at] == run[at + step]]
        if not len(at):
            break
        mine = at[(side[at] != side[at + step]) | (side[at] == 0)]
        mine = mine[group[mine] != group[mine + step]]
        i, j = close_pairs(prints, table, mine, mine + step, radius)
        held.append((i, j))
        n += len(i)
        if n > PAIRS // 16:
            group, held, n = joined(group, *map(np.concatenate, zip(*held))), [], 0
        step += 1
    return joined(group, *map(np.concatenate, zip(*held))) if held else group


def with_fingerprints(docs: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """id and fingerprint (as a signed long) of each row."""
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))

    def run(batches):
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()).view(np.int64))], ["id", "print"])

    return rows.transform(in_batches, run, f"id {rows.schema['id'].dataType.simpleString()}, print long")


def edges_of(bits: list[int], parts: int) -> list[list[int]]:
    """bits cut into consecutive parts whose sizes differ by one at most."""
    ends = [len(bits) * k // parts for k in range(parts + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:])]


def mask(bits: list[int]) -> Column:
    return F.lit(int(np.array(sum(1 << b for b in bits), np.uint64).view(np.int64)))


def keys_of(bits: list[int], parts: int, radius: int = RADIUS) -> list[list[int]]:
    """Sets of bits of which any two fingerprints that differ in at most radius of the bits agree in one."""
    cut = edges_of(bits, parts)
    return [sum(kept, []) for kept in combinations(cut, parts - radius)]


def crowds(member: DataFrame) -> DataFrame:
    """Rows of member (key, ...) whose key has several, with their number c."""
    return member.join(member.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key")


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of fingerprints (column print, each once) that join all linked ones; u and v are of one component."""
    first = keys_of(list(range(64)), SEGMENTS)
    pieces = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.col("print").bitwiseAND(mask(bits))).alias("key")) for k, bits in enumerate(first)]
    member = prints.select("print", F.explode(F.array(*pieces)).alias("p")).select("p.k", "p.key", "print")
    inside = settled(crowds(member))
    # large keys once more, by parts of the bits that they leave
    second = [[F.xxhash64("key", F.lit(n), F.col("print").bitwiseAND(mask(cut))) for n, cut in enumerate(keys_of([b for b in range(64) if b not in bits], CUTS))] for bits in first]
    large = inside.where(F.col("c") > block).select("print", F.explode(F.element_at(F.array(*[F.array(*x) for x in second]), F.col("k") + 1)).alias("key"))
    rows = inside.where(F.col("c") <= block).select("key", "print", "c").unionByName(crowds(large).select("key", "print", "c"))
    parts = F.ceil(F.col("c") / block).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("print", "key"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a block with itself is side 0 alone; with another one the two are sides 1 and 2
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    rows = rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("run"), side.alias("side"), "print")

    def run(batches):
        held = None

        def found(batch):
            keys, sides, values = (batch.column(k).to_numpy() for k in range(3))
            group = groups_in_runs(keys, sides, values.view(np.uint64))
            own = np.flatnonzero(group != np.arange(len(group)))
            return pa.RecordBatch.from_arrays([pa.array(values[own]), pa.array(values[group[own]])], ["u", "v"])

        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = held.column(0).to_numpy()
            # the last run may go on in the next batch
            done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if done:
                yield found(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield found(held)

    dealt = rows.repartition(partitions(rows.sparkSession), "run").sortWithinPartitions("run", "side", "print")
    return dealt.transform(in_batches, run, "u long, v long", 10_000)


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of each row."""
    seen = settled(with_fingerprints(docs, text_column, id_column))
    prints = settled(seen.groupBy("print").agg(F.min("id").alias("least")))
    label = components(links(prints.select("print"), block)).select(F.col("node").alias("print"), "label")
    member = settled(prints.join(label, "print", "left").select("print", "least", F.coalesce("label", "print").alias("label")))
    ids = member.groupBy("label").agg(F.min("least").alias("component_id"))
    known = settled(member.join(ids, "label").select("print", "component_id"))
    out = seen.join(known, "print")
    return out.select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
