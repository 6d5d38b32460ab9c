"""Byte strings of 200 that occur more than once, by interval expansion on a Burrows-Wheeler transform.

Super-k-mers bring equal windows to one bucket (see superkmers). There the strings of a block are joined,
their suffixes are sorted, and the transform is extended backwards, breadth first: common-prefix values
come out in increasing order, each boundary of value l between two rows making one of value l + 1
between the rows that their left neighbours lead to. The search stops at the window's length; rows with
no boundary between them by then start with the same window.

A block's suffixes are sorted by the window's bytes alone: those that agree in all of them may stand in any
order, as no boundary is asked for between them.

Defined results: a null or empty text, or one of fewer bytes than the window, keeps all bytes; equal texts
(exact copies, also under one doc_id) lose all bytes if long enough, first ones included; texts of any
length are read in pieces that overlap; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches
from seqloom.llm.superkmers import ANYWHERE, HOT, Kind, covered_units, few_rows, mixed, repeated_spans, span_arrays, with_spans

LENGTH = 200
MINIMISER = 40
BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64))


def suffix_order(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Suffixes of text in order of their first `length` bytes."""
    n = len(text)
    names = np.zeros(258, np.uint64)
    present = np.unique(text)
    names[present] = np.arange(1, len(present) + 1)
    bits = len(present).bit_length()
    depth = min(63 // bits, length)
    padded = np.concatenate([names[text], np.zeros(depth, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    order = np.argsort(key)
    together = 63 // (n + 1).bit_length()  # ranks that one key holds
    while depth < length:
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if rank[order[-1]] == n:
            break
        key, done = rank.copy(), depth
        for _ in range(together - 1):
            # the next rank's bytes end where the key's bytes do then; in the last one they may overlap
            step = min(depth, length - done)
            at, done = done - depth + step, done + step
            key *= n + 1
            key[: max(n - at, 0)] += rank[at:]
            if done == length:
                break
        depth = done
        order = np.argsort(key)
    return order


def boundaries(bwt: np.ndarray, length: int) -> np.ndarray:
    """Flags of the rows whose common prefix with the row before is shorter than `length`.

    A boundary of value l, extended backwards, makes one of value l + 1 between the two neighbouring rows of each
    byte that stand on both sides of it; each row gets its value once, in the round of that value.
    Two rows whose left neighbours are led to from rows that are neighbours themselves have one boundary that can part
    them, and follow it one round later; in repeated text that is nearly all of them. Only the others are searched for in each round.
    """
    n = len(bwt)
    source = np.argsort(bwt, kind="stable").astype(np.int32)  # the row that each row comes from by one byte to the left
    byte = bwt[source]
    found = np.ones(n, bool)
    found[1:] = byte[1:] != byte[:-1]
    fresh = np.flatnonzero(found).astype(np.int32)
    row = np.flatnonzero(~found).astype(np.int32)
    above, below = source[row - 1], source[row]
    near = below - above == 1
    after = np.zeros(n, np.int32)  # the row that follows a boundary; 0: none
    after[below[near]] = row[near]
    row, above, below = row[~near], above[~near], below[~near]
    for _ in range(1, length):
        if not len(fresh):
            break
        made = after[fresh]
        made = made[made > 0]
        if len(row):
            if 4 * max(len(fresh), len(row)) < n:
                places = np.sort(fresh)
                cut = np.searchsorted(places, below, "right") > np.searchsorted(places, above, "right")
            else:
                flags = np.zeros(n, bool)
                flags[fresh] = True
                upto = np.cumsum(flags, dtype=np.int32)
                cut = upto[below] > upto[above]
            if cut.any():
                made = np.concatenate([made, row[cut]])
                row, above, below = row[~cut], above[~cut], below[~cut]
        found[made] = True
        fresh = made
    return found


def repeated_starts(text: np.ndarray, valid: np.ndarray, times: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of each start among `valid` whose first `length` bytes occur more than once, else -1. times: how often each start counts."""
    n = len(text)
    order = suffix_order(text, length)
    group = np.cumsum(boundaries(text[order - 1], length)) - 1
    ok = valid[order]
    size = np.bincount(group[ok], weights=times[order[ok]], minlength=group[-1] + 1)
    out = np.full(n, -1, np.int64)
    again = ok & (size[group] > 1)
    out[order[again]] = group[again]
    return out


def compare(strings: list[bytes], times: np.ndarray, first: np.ndarray, repeats: str, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the windows that also start elsewhere."""
    sizes = np.array([len(s) for s in strings])
    # bytes from 1, and the end mark 0 that the transform needs
    text = np.append(np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + np.uint16(1), np.uint16(0))
    begins = np.cumsum(sizes) - sizes
    valid = np.ones(len(text), bool)
    valid[-1] = False
    for b, n in zip(begins, sizes):
        valid[max(b, b + n - length + 1) : b + n] = False
    found = repeated_starts(text, valid, np.append(np.repeat(times, sizes), 0), length) >= 0
    return [found[b : b + max(n - length + 1, 0)] for b, n in zip(begins, sizes)]


BYTES = Kind(LENGTH, MINIMISER, lambda data: data, lambda data: BYTE_HASH[np.frombuffer(data, np.uint8)], lambda data: None, compare)


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT, keep: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with `keep` also the remaining bytes."""
    spans = repeated_spans(docs, BYTES, ANYWHERE, id_column=id_column, text_column=text_column, hot=hot)
    joined, _ = with_spans(docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")), spans, "id", "text")
    names, types = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    width = 4 + keep

    def run(batches):
        for batch in few_rows(batches):
            rows = []
            for text, own in zip(batch.column(1).to_pylist(), span_arrays(batch.column(2))):
                raw, removed, runs = text.encode(), 0, 0
                kept = raw
                if own:
                    gone = covered_units(len(raw), own)
                    kept, removed = np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone))
                    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array([r[c] for r in rows], types[c]) for c in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names[:width]])

    id_type = joined.schema["id"].dataType.simpleString()
    out = joined.select("id", "text", "_spans").transform(in_batches, run, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
    return out.withColumnRenamed("id", id_column)
