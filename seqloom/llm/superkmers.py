"""Repeated windows of a corpus, found through super-k-mers.

Every window of `length` units (bytes or words) has a minimiser: of its runs of `k` units the one of the
smallest hash, the left one of equals. Equal windows have equal minimisers at equal places, so a window
can only repeat where its minimiser does. Consecutive windows that share the minimiser's place are one
super-k-mer: `length - 1` units more than it has windows.

1. Each text gives a row per super-k-mer: hash of the minimiser, digest of the content's bytes, place.
2. A minimiser that occurs once is done with. Occurrences of one content are counted before the shuffle,
   so a text with thousands of copies weighs no more than one row in each task.
3. One of each content travels as a packed string, with its count and smallest id, to its minimiser's
   bucket, where a caller's `compare` sorts the windows and counts them. A super-k-mer has no window twice, so where a
   minimiser has one content alone there is nothing to sort: each of its windows occurs as often as it does.
4. A bucket of more than `hot` bytes (a passage in very many contexts) would fill one task. Its strings are cut
   again by a second minimiser of another order of hashes; pieces are counted and compared as strings were.
   What is too large even then is cut into its windows, each of which is a string of its own.
5. The covered spans go back to their texts.

Hashes only choose places and buckets: whatever collides there meets in one bucket, where bytes are compared.
Contents are the same where 128-bit keyed BLAKE2 digests of their bytes are, rows where id and a hash of
id and text are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import fresh, in_batches, settled, text_or_empty

#: Units that are looked at together; longer texts are cut into such pieces, which overlap by a window.
PIECE = 1 << 20
#: Bytes of different strings that one bucket may hold.
HOT = 1 << 18
BLOCK_BYTES = 1 << 19
ODD, EVEN_ODDS, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = np.uint64(22)
PLACE = np.uint64((1 << 22) - 1)
#: Whether a window repeats where it starts elsewhere at all, or in a smaller id only.
ANYWHERE, SMALLER = "anywhere", "smaller"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * EVEN_ODDS
    x = (x ^ (x >> np.uint64(27))) * FINAL
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _POWERS:
        _POWERS[size] = powers(BASE, size), powers(BASE_INVERSE, size)
    return _POWERS[size]


class Hashes:
    """Hashes of runs of units, from sums over the units before. They choose places and buckets; nothing is equal for their sake alone."""

    def __init__(self, units: np.ndarray):
        up, self.down = base_powers(len(units))
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[: len(units)], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[:n])


def super_kmers(units: np.ndarray, length: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and number of windows of each super-k-mer of one piece; each seed has its own order of hashes."""
    if len(units) < length:
        none = np.empty(0, np.int64)
        return none, none, none
    own = Hashes(units).all(k)
    if seed:
        own = mixed(own + np.uint64(seed) * ODD)
    keyed = (own & ~PLACE) | np.arange(len(own), dtype=np.uint64)
    width = length - k + 1
    step = 1
    while step * 2 <= width:  # smallest of 2, 4, 8, ... places
        keyed = np.minimum(keyed[:-step], keyed[step:])
        step *= 2
    rest = width - step
    if rest:
        keyed = np.minimum(keyed[:-rest], keyed[rest:])
    place = (keyed & PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return own[place[first]].view(np.int64), first, np.diff(first, append=len(place))


@dataclass(frozen=True)
class Kind:
    """What a text is cut into. normal: bytes as they are compared; units: hashes of the units of such bytes; begins: where each unit begins, and one past the end (None: units are bytes)."""

    length: int
    k: int
    normal: Callable[[bytes], bytes]
    units: Callable[[bytes], np.ndarray]
    begins: Callable[[bytes], np.ndarray | None]
    #: (strings, how often each occurs, rank of each one's smallest id, repeats) -> for each string the windows that repeat, as flags.
    compare: Callable[[list[bytes], np.ndarray, np.ndarray, str], list[np.ndarray]]

    def strings(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each range of units."""
        begins = self.begins(data)
        if begins is not None:
            starts, ends = begins[starts], begins[ends] - 1
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def windows(self, string: bytes) -> int:
        begins = self.begins(string)
        return (len(string) if begins is None else len(begins) - 1) - self.length + 1


def digest(string: bytes) -> bytes:
    return hashlib.blake2b(string, digest_size=16, key=b"super-k-mer").digest()


def keyed_rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = text_or_empty(text_column)
    return docs.select(F.col(id_column).alias("id"), F.xxhash64(F.col(id_column), text).alias("row"), text.alias("text"))


def super_kmer_rows(keyed: DataFrame, kind: Kind, contents: bool) -> DataFrame:
    """a (minimiser) and id of each super-k-mer; with `contents` also s (digest), size (bytes), row, at (first unit) and n (windows)."""

    def run(batches):
        for batch in batches:
            parts, strings, owner = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = kind.normal(text.encode())
                units, at = kind.units(data), 0
                while at == 0 or at + kind.length <= len(units):
                    a, first, n = super_kmers(units[at : at + PIECE], kind.length, kind.k)
                    if len(a):
                        parts.append((a, first + at, n))
                        owner.append(np.full(len(a), i))
                        if contents:
                            strings += [(digest(x), len(x)) for x in kind.strings(data, first + at, first + at + n + kind.length - 1)]
                    at += PIECE - kind.length + 1
                if sum(map(len, owner)) > 200_000 or i + 1 == batch.num_rows:
                    if parts:
                        a, first, n = (np.concatenate(x) for x in zip(*parts))
                        at = pa.array(np.concatenate(owner))
                        columns = [pa.array(a), batch.column(0).take(at)]
                        if contents:
                            s, size = zip(*strings)
                            columns += [batch.column(1).take(at), pa.array(s, pa.binary()), pa.array(size, pa.int32()), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, ["a", "id", "row", "s", "size", "at", "n"][: len(columns)])
                    parts, strings, owner = [], [], []

    id_type = keyed.schema["id"].dataType.simpleString()
    return keyed.select("id", "row", "text").transform(in_batches, run, f"a long, id {id_type}" + ", row long, s binary, size int, at int, n int" * contents)


def runs_of(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edges[::2], edges[1::2])]


RUNS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
RUNS_SQL = "array<struct<lo:int,hi:int>>"


def packed_strings(kinds: DataFrame, keyed: DataFrame, kind: Kind) -> DataFrame:
    """a, s, first, times, hot and string of each distinct super-k-mer (a, s, first, times, hot, rep), cut from the text it was seen in."""
    wanted = kinds.select(F.col("rep.id").alias("own"), F.col("rep.row").alias("row"), F.struct("a", "s", "first", "times", "hot", F.col("rep.at").alias("at"), F.col("rep.n").alias("n")).alias("w"))
    # a text's own super-k-mers: no more than its length
    wanted = wanted.groupBy("own", "row").agg(F.collect_list("w").alias("w"))
    id_type = kinds.schema["first"].dataType.simpleString()
    joined = keyed.join(wanted.withColumnRenamed("row", "of"), (F.col("row") == F.col("of")) & F.col("id").eqNullSafe(F.col("own"))).select("row", "text", "w")

    def run(batches):
        done = set()  # rows of one id and text send their strings once
        for batch in batches:
            w_type = batch.schema.field("w").type.value_type
            for i, row in enumerate(batch.column(0).to_pylist()):
                if row in done:
                    continue
                done.add(row)
                w = batch.column(2)[i].values
                at = w.field("at").to_numpy()
                data = kind.normal(batch.column(1)[i].as_py().encode())
                strings = kind.strings(data, at, at + w.field("n").to_numpy() + kind.length - 1)
                names = ["a", "s", "first", "times", "hot"]
                yield pa.RecordBatch.from_arrays([*(w.field(c).cast(w_type.field(c).type) for c in names), pa.array(strings, pa.binary())], [*names, "string"])

    return joined.transform(in_batches, run, f"a long, s binary, first {id_type}, times long, hot boolean, string binary")


def compared(strings: DataFrame, kind: Kind, repeats: str) -> DataFrame:
    """a, s and the runs of windows that repeat, of strings (a, s, first, times, string) whose buckets fit into a task."""

    def block(held):
        a, s, first, times, string, lone = ([x for part in held for x in part[i]] for i in range(6))
        order = sorted({x for x in first if x is not None})
        rank = dict(zip(order, range(len(order))))
        ranks, times = np.array([rank.get(x, len(order)) for x in first], np.int64), np.array(times, np.int64)
        together = [i for i, alone in enumerate(lone) if not alone]
        flags = dict(zip(together, kind.compare([string[i] for i in together], times[together], ranks[together], repeats))) if together else {}
        runs = []
        for i, alone in enumerate(lone):
            if not alone:
                runs.append(runs_of(flags[i]))
            # a super-k-mer has no window twice: alone in its bucket, its windows occur as often as it does itself
            else:
                runs.append([{"lo": 0, "hi": kind.windows(string[i])}] if repeats == ANYWHERE and times[i] > 1 else [])
        some = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([a[i] for i in some], pa.int64()), pa.array([s[i] for i in some], pa.binary()), pa.array([runs[i] for i in some], RUNS)], ["a", "s", "runs"])

    def run(batches):
        held, size, bucket, last = [], 0, None, None

        def close():
            if bucket is not None:
                held.append((*bucket, [len(bucket[0]) == 1] * len(bucket[0])))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket is None or row[0] != last:  # a block ends between two buckets
                    close()
                    if size >= BLOCK_BYTES:
                        yield block(held)
                        held, size = [], 0
                    bucket, last = ([], [], [], [], []), row[0]
                elif row[1] == bucket[1][-1]:
                    continue
                for column, value in zip(bucket, row):
                    column.append(value)
                size += len(row[4])
        close()
        if held:
            yield block(held)

    rows = strings.select("a", "s", "first", "times", "string").repartition("a").sortWithinPartitions("a", "s")
    return rows.transform(in_batches, run, f"a long, s binary, runs {RUNS_SQL}")


def cut_again(strings: DataFrame, kind: Kind, seed: int, repeats: str, hot: int) -> DataFrame:
    """The same of strings whose buckets are too large: cut by another minimiser, or with seed 0 into single windows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(4)[i].as_py()
                if seed:
                    key, off, n = super_kmers(kind.units(data), kind.length, kind.k, seed)
                    key = mixed(key.view(np.uint64) + np.array([batch.column(0)[i].as_py()], np.int64).view(np.uint64) * ODD).view(np.int64)
                else:
                    off = np.arange(kind.windows(data))
                    n = np.ones_like(off)
                pieces = kind.strings(data, off, off + n + kind.length - 1)
                digests = [digest(x) for x in pieces]
                if not seed:
                    key = np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64)
                same = pa.array(np.full(len(off), i))
                own = [batch.column(c).take(same) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(off.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(digests, pa.binary()), pa.array(pieces, pa.binary())], ["oa", "os", "mine", "times", "off", "n", "a", "s", "string"])

    first_type = strings.schema["first"].dataType.simpleString()
    pieces = settled(strings.select("a", "s", "first", "times", "string").transform(in_batches, run, f"oa long, os binary, mine {first_type}, times long, off int, n int, a long, s binary, string binary"))
    kinds = settled(pieces.groupBy("a", "s").agg(F.min("mine").alias("first"), F.sum("times").alias("times"), F.first("string").alias("string")))
    if seed:
        sizes = settled(kinds.groupBy("a").agg(F.sum(F.length("string")).alias("bytes"), F.sum("times").alias("all")).where("all > 1"))
        some = kinds.join(sizes, "a")
        runs = compared(some.where(F.col("bytes") <= hot), kind, repeats)
        large = some.where(F.col("bytes") > hot)
        if not large.isEmpty():
            runs = runs.unionByName(cut_again(large, kind, 0, repeats, hot))
    else:
        runs = kinds.where("times > 1" if repeats == ANYWHERE else "false").select("a", "s", F.array(F.struct(F.lit(0).alias("lo"), F.lit(1).alias("hi"))).alias("runs"))
    known = kinds.select("a", "s", "first").join(runs, ["a", "s"], "left")
    whole = F.array(F.struct(F.col("off").alias("lo"), (F.col("off") + F.col("n")).alias("hi")))
    part = F.transform("runs", lambda r: F.struct((F.col("off") + r["lo"]).alias("lo"), (F.col("off") + r["hi"]).alias("hi")))
    # a piece that an earlier document has goes as a whole; runs are those of the first document's
    own = F.when(F.lit(repeats == SMALLER) & (F.col("first") < F.col("mine")), whole).otherwise(part)
    found = pieces.join(known, ["a", "s"]).select("oa", "os", own.alias("runs")).where(F.size("runs") > 0)
    return found.groupBy(F.col("oa").alias("a"), F.col("os").alias("s")).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_spans(docs: DataFrame, kind: Kind, repeats: str, *, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """id, row and spans (struct start, end in units; unsorted, overlapping) of each text that has a repeated window."""
    keyed = keyed_rows(docs, id_column, text_column)
    if repeats == SMALLER:  # a null id is no smaller one, and none is smaller than it
        keyed = keyed.where("id IS NOT NULL")
    anchors = super_kmer_rows(keyed, kind, contents=False).groupBy("a").agg(F.count("*").alias("total"), F.min("id").alias("low"), F.max("id").alias("high"))
    anchors = settled(anchors.where("total > 1" if repeats == ANYWHERE else "low < high").select("a"))
    seen = settled(super_kmer_rows(keyed, kind, contents=True).join(anchors, "a"))
    kinds = settled(seen.groupBy("a", "s").agg(F.count("*").alias("times"), F.min("id").alias("first"), F.max("size").alias("size"), F.min(F.struct("id", "row", "at", "n")).alias("rep")))
    sizes = settled(kinds.groupBy("a").agg(F.count("*").alias("different"), F.sum("size").alias("bytes")), free=False)
    strings = packed_strings(kinds.join(sizes.where("different > 1").select("a", (F.col("bytes") > hot).alias("hot")), "a"), keyed, kind)
    if sizes.where((F.col("different") > 1) & (F.col("bytes") > hot)).isEmpty():
        runs = compared(strings, kind, repeats)
    else:
        strings = settled(strings)
        runs = compared(strings.where("not hot"), kind, repeats).unionByName(cut_again(strings.where("hot"), kind, 1, repeats, hot))
    if repeats == ANYWHERE:
        alone = kinds.where("times > 1").join(sizes.where("different = 1").select("a"), "a")
        runs = runs.unionByName(alone.select("a", "s", F.array(F.struct(F.lit(0).alias("lo"), F.col("rep.n").alias("hi"))).alias("runs")))
    known = settled(kinds.select("a", "s", "first").join(runs, ["a", "s"], "left"))
    whole = F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("n") + (kind.length - 1)).alias("end")))
    part = F.transform("runs", lambda r: F.struct((F.col("at") + r["lo"]).alias("start"), (F.col("at") + r["hi"] + (kind.length - 1)).alias("end")))
    # a super-k-mer that an earlier document has goes as a whole; runs are those of the first document's
    spans = F.when(F.lit(repeats == SMALLER) & (F.col("first") < F.col("id")), whole).otherwise(part)
    found = seen.join(known, ["a", "s"]).select("id", "row", spans.alias("spans")).where(F.size("spans") > 0)
    # a text's own spans; rows of one id and one text have the same ones, which count once
    return found.groupBy("id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, str]:
    """docs with the spans of their texts in a further column, and that column's name."""
    key, row, column = fresh(docs, "_key"), fresh(docs, "_row"), fresh(docs, "_spans")
    own = F.xxhash64(F.col(id_column), text_or_empty(text_column))
    found = spans.select(F.col("id").alias(key), F.col("row").alias(row), F.col("spans").alias(column))
    return docs.join(found, (own == F.col(row)) & F.col(id_column).eqNullSafe(F.col(key)), "left").drop(key, row), column


def few_rows(batches, rows: int = 500):
    """Batches in parts of some rows, so that little is in memory beside them."""
    return (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def span_arrays(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Starts and ends of each row's spans, None for a row without."""
    offsets = column.offsets.to_numpy()
    start, end = (column.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return [(start[a:b], end[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]


def covered_units(n: int, spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Flags of the n units inside spans."""
    edges = np.bincount(spans[0], minlength=n + 1) - np.bincount(spans[1], minlength=n + 1)
    return np.cumsum(edges[:-1]) > 0
