"""Quality classifier: logistic regression on hashed word n-grams, learnt by follow-the-regularised-leader.

A token is a run of letters and digits (any byte beyond ASCII counts as one) or a run of other visible
characters, in the case it has. Single tokens and pairs of neighbours are hashed into 2**bits places, and a token that repeats the one before it counts at one more place;
a document is the sparse vector of their counts divided by the square root of their number. Training
takes a bounded sample of the labelled rows (`max_rows` labels, those of the smallest hashes of their ids, and of the documents
that have them again `max_rows`), makes their vectors where they are read, and updates per-coordinate FTRL-proximal weights in
the order of the hashes. Scoring is one pass of sparse dot products in the tasks that read the texts; the weights
(2**bits floats) are broadcast.

Defined results: a null or empty text, or one without tokens, gets the score of the bias; rows without a
label, or whose label is null, are not learnt from; several labels of one doc_id are each learnt; without
any usable label all scores are 0.5; equal texts get equal scores; other columns are no inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches, text_or_empty

BITS = 18
MAX_ROWS = 12_000
ODD = np.uint64(0x9E3779B97F4A7C15)
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
BASE = np.uint64(0x100000001B3)
AGAIN = np.uint64(0xD6E8FEB86659FD93)


def byte_classes() -> np.ndarray:
    """0: space and controls, 1: part of a word, 2: other."""
    out = np.full(256, 2, np.uint8)
    out[:33], out[127] = 0, 0
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        out[a:b] = 1
    return out


CLASSES = byte_classes()


def hashed(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The places of all n-grams of the texts, and how many each text has: its tokens', then its pairs'."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    kind = CLASSES[data]
    first = np.flatnonzero((kind != 0) & (kind != np.concatenate([[0], kind[:-1]])))
    if not len(first):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    token_bytes = data[kind != 0].astype(np.uint64) + np.uint64(1)
    lengths = np.add.reduceat((kind != 0).astype(np.int64), first)
    offsets = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), BASE)]))
    tokens = np.add.reduceat(token_bytes * powers[np.arange(len(token_bytes)) - np.repeat(offsets, lengths)], offsets)
    tokens = (tokens ^ (tokens >> np.uint64(29))) * ODD
    pairs = (tokens[:-1] * PAIR + tokens[1:]) * ODD
    upto = np.searchsorted(first, ends)
    n = np.diff(upto, prepend=0)
    last = np.zeros(len(tokens), bool)
    last[upto[n > 0] - 1] = True
    owner = np.repeat(np.arange(len(texts)), n)
    keep = ~last[:-1]
    shift = np.uint64(64 - bits)
    # a pair of equal tokens is also the pair that all repetitions share
    again = keep & (tokens[:-1] == tokens[1:])
    places = np.concatenate([tokens >> shift, pairs[keep] >> shift, np.full(np.count_nonzero(again), AGAIN >> shift, np.uint64)]).astype(np.int64)
    owners = np.concatenate([owner, owner[:-1][keep], owner[:-1][again]])
    order = np.argsort(owners, kind="stable")
    return places[order], np.bincount(owners, minlength=len(texts))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        places, counts = hashed(texts, self.bits)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
        ends = np.cumsum(counts)
        dots = (sums[ends] - sums[ends - counts]) / np.sqrt(np.maximum(counts, 1))
        # rounded: where a text stands in a batch doesn't show
        return np.round(1 / (1 + np.exp(-np.clip(dots + self.bias, -30, 30))), 6)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss; the last coordinate is the bias."""

    def __init__(self, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.3):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - label) * values
        step = (np.sqrt(self.n[places] + g * g) - np.sqrt(self.n[places])) / self.alpha
        self.z[places] += g - step * w
        self.n[places] += g * g


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = 2) -> Model:
    """Learns from the labelled rows that aren't held out, max_rows of them at most."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    # bounded by max_rows: sent to the tasks that read the documents
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows))
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).join(known, "id")

    def vectors(batches):
        for batch in batches:
            places, values = [], []
            texts = batch.column(1).to_pylist()
            for text in texts:
                own, _ = hashed([text.encode()], bits)
                at, n = np.unique(own, return_counts=True)
                places.append(at.astype(np.int32))
                values.append((n / np.sqrt(max(len(own), 1))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), batch.column(3)], ["id", "label", "places", "of", "own"])

    kind = docs.schema[id_column].dataType.simpleString()
    sparse = rows.select("id", "text", "label", F.xxhash64("text").alias("own")).transform(in_batches, vectors, f"id {kind}, label int, places array<int>, of array<float>, own long")

    def train(batches):
        model, held = Ftrl(bits), []
        for batch in batches:
            for label, at, of in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                held.append((label, np.append(at.values.to_numpy(zero_copy_only=False), np.int32(1 << bits)), np.append(of.values.to_numpy(zero_copy_only=False), np.float32(1))))
        for _ in range(epochs):
            for label, at, of in held:
                model.update(at, of.astype(np.float64), label)
        w = model.weights()
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([w[used].astype(np.float32)], pa.list_(pa.float32()))], ["places", "weights"])

    # one id may have many documents: the bound holds for what reaches the task that learns
    learnt = sparse.orderBy(F.xxhash64("id"), "id", "label", "own").limit(max_rows).transform(in_batches, train, "places array<int>, weights array<float>").collect()
    weights = np.zeros((1 << bits) + 1, np.float32)
    for row in learnt:
        weights[np.array(row["places"], np.int64)] = row["weights"]
    return Model(weights[:-1], float(weights[-1]), bits)


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs' id, held_out, score and predicted (1 where the score is 0.5 or more)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [x.encode() for x in batch.column(1).to_pylist()]
            parts, at = [np.empty(0)], 0
            while at < len(texts):  # some megabytes at a time
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size < 4_000_000:
                    size, end = size + len(texts[end]), end + 1
                parts.append(sent.value.scores(texts[at:end]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts), pa.float64())], ["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).transform(in_batches, run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_column), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, *, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without those that score below the threshold; their columns stay as they are."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                texts = [(x or "").encode() for x in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(sent.value.scores(texts) >= threshold))

    return docs.transform(in_batches, run, docs.schema)
