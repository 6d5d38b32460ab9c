"""Vector code compression: product codes of integer vectors, nearest entries found by annular norm pruning.

Each component x becomes floor(4096 * x); a vector is cut into `parts` equal consecutive parts, and each part position has a
codebook of up to `entries` entries. A part's nearest entry (squared Euclidean distance, ties to the lower index) is found so:

1. The codebook's entries are sorted by norm.
2. The entry whose norm is next to the part's gives a first distance d.
3. An entry whose norm differs from the part's by more than d is farther away than that. A binary search gives the interval of
   norms that d allows, both ends included, and the entries in that annulus alone are evaluated, exactly, in 64-bit integers.

Square roots only place the interval, which is widened by more than they are rounded; distances and ties are decided by integers.

Training is Lloyd's: each round assigns all rows in the tasks that hold them, a task gives its sums by (part, entry), and those
are summed by one small aggregation. What the driver gets is the codebooks, of a size that doesn't grow with the rows. Integer
vectors are written to the shared folder once and read by every round.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; a null id counts after all others
where the first codebook is taken from the smallest ids, and rows of one id stand by their vectors; with fewer rows than entries the
codebooks are smaller; no rows give no rows; equal rows have equal codes. Vectors of different lengths, a length that
can't be cut into the parts, and components of 2**16 or more are errors, as their distances aren't defined or may not fit in 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches, settled

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components that are this large could overflow sums of squares.
LARGEST = 1 << 16


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def allowed(norms: np.ndarray, size: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (the latter not included) of the sorted norms that differ from size by no more than the root of best."""
    reach = np.sqrt(best.astype(np.float64))
    reach += 1e-9 * (reach + size) + 1e-6
    return np.searchsorted(norms, size - reach, "left"), np.searchsorted(norms, size + reach, "right")


def annulus(entries: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry and its squared distance. entries: (k, width), parts: (n, width), both int64."""
    by_norm = np.argsort(np.sqrt((entries * entries).sum(axis=1).astype(np.float64)), kind="stable")
    own = entries[by_norm]
    norms = np.sqrt((own * own).sum(axis=1).astype(np.float64))
    size = np.sqrt((parts * parts).sum(axis=1).astype(np.float64))

    def distances(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        d = parts[i] - own[k]
        return (d * d).sum(axis=1)

    rows = np.arange(len(parts))
    right = np.minimum(np.searchsorted(norms, size), len(norms) - 1)
    left = np.maximum(right - 1, 0)
    first = np.where(size - norms[left] <= norms[right] - size, left, right)
    best, index = distances(rows, first), by_norm[first]
    lo, hi = allowed(norms, size, best)
    for step in range(int((hi - lo).max(initial=0))):
        at = rows[lo + step < hi]
        k = lo[at] + step
        d, to = distances(at, k), by_norm[k]
        better = (d < best[at]) | ((d == best[at]) & (to < index[at]))
        best[at[better]], index[at[better]] = d[better], to[better]
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """books[p][k]: entry k of part position p, integers."""

    books: tuple

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances, (n, parts) each."""
        cut = np.split(vectors, len(self.books), axis=1)
        found = [annulus(np.array(book, np.int64), part) for book, part in zip(self.books, cut)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def vectors_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Lists of one length each as the rows of an array."""
    flat = batch.column(column).flatten().to_numpy().astype(np.int64)
    return flat.reshape(batch.num_rows, len(flat) // max(1, batch.num_rows))


def integers(df: DataFrame, *, id_column: str, vector_column: str, label_column: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """id, label and vector (integers) of the usable rows; written once."""
    x = F.col(vector_column)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = df.where(usable(x)).select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), whole.alias("vector"))
    wide = F.exists("vector", lambda c: F.abs(c) >= LARGEST * scale)
    fits = F.when(wide, F.raise_error(F.lit(f"a component is {LARGEST} or more"))).when(F.size("vector") % parts != 0, F.raise_error(F.lit(f"a vector can't be cut into {parts} parts"))).otherwise(F.col("vector"))
    rows = settled(rows.select("id", "label", fits.cast("array<int>").alias("vector")))
    widths = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b")).first()
    if widths["a"] != widths["b"]:
        raise ValueError(f"vectors of {widths['a']} and of {widths['b']} components")
    return rows


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors of the smallest ids."""
    least = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    vectors = [r["vector"] for r in least]
    width = len(vectors[0]) // parts if vectors else 0
    return Codebooks(tuple(tuple(tuple(v[p * width : (p + 1) * width]) for v in vectors) for p in range(parts)))


def means(rows: DataFrame, now: Codebooks) -> Codebooks:
    """Each entry replaced by the mean of the parts that are nearest to it."""
    width = len(now.books[0][0])

    def run(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            vectors = vectors_of(batch, 0)
            index, _ = now.assign(vectors)
            for p, part in enumerate(np.split(vectors, len(now.books), axis=1)):
                for k in np.unique(index[:, p]).tolist():
                    mine = part[index[:, p] == k]
                    old = total.get((p, k), [0] * (width + 1))
                    total[p, k] = [a + b for a, b in zip(old, [len(mine), *mine.sum(axis=0).tolist()])]
        if total:
            yield pa.RecordBatch.from_pylist([{"part": p, "entry": k, "n": x[0], "total": x[1:]} for (p, k), x in total.items()], schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    sums = rows.select("vector").transform(in_batches, run, "part int, entry int, n long, total array<long>", 4096)
    # a quotient as a double could be rounded up to a whole number: the driver divides integers
    added = [F.sum(F.col("total")[j]).alias(f"c{j}") for j in range(width)]
    books = [list(book) for book in now.books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        books[r["part"]][r["entry"]] = tuple(r[f"c{j}"] // r["n"] for j in range(width))
    return Codebooks(tuple(map(tuple, books)))


def train(rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of integer vectors (column vector) after so many rounds."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.books[0] else 0):
        books = means(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (two hexadecimal digits for each part) and error (squared distances summed over the parts) of integer vectors."""

    def run(batches):
        for batch in batches:
            index, error = books.assign(vectors_of(batch, 2))
            code = [bytes(row).hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error.sum(axis=1), pa.int64())], ["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "label", "vector").transform(in_batches, run, f"id {types['id']}, label {types['label']}, code string, error long", 4096)


def decode(codes: DataFrame, books: Codebooks, *, code_column: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with `vector`, what a code stands for, as doubles."""
    places = [F.element_at(F.array(*[F.array(*[F.lit(x / scale) for x in entry]) for entry in book]), F.conv(F.substring(code_column, 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, book in enumerate(books.books)]
    return codes.withColumn("vector", F.concat(*places))


def compress(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id, label, code, error, label_error (errors summed over equal labels, nulls together) and codebooks_sha256 of each usable row."""
    rows = integers(df, id_column=id_column, vector_column=vector_column, label_column=label_column, parts=parts)
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    coded = settled(encode(rows, books) if books.books[0] else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "own")
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("own")))
    return out.select(F.col("id").alias(id_column), F.col("label").alias(label_column), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
