"""Substring dedup by words: super-k-mers in buckets, windows counted exactly by sorting.

A window is 50 consecutive words. A word goes if it lies in a window whose words also start in a document
of a smaller id. Consecutive windows that share a minimiser travel to its bucket as one packed string (see
superkmers); there the words are numbered, and windows are sorted by doubling: numbers of 1, 2, 4, ... words
are made of pairs of numbers, so equal numbers are equal windows, and each takes its smallest id.

Defined results: a null or empty text, or one of fewer than 50 words, keeps all its words; of equal texts
the smallest id keeps its words, rows of that same id too; a null id is no smaller id, and loses nothing;
texts of any length are read in pieces that overlap; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import in_batches
from seqloom.llm.superkmers import HOT, ODD, SMALLER, Kind, covered_units, few_rows, mixed, repeated_spans, span_arrays, with_spans

LENGTH = 50
MINIMISER = 8
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ of UTF-8 bytes."""
    b = np.frombuffer(data, np.uint8)
    word = ~BLANK[b]
    first = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if not len(first):
        return np.empty(0, np.uint64)
    own = b[word].astype(np.uint64) + np.uint64(1)
    last = np.flatnonzero(word & ~np.append(word[1:], False))
    lengths = last - first + 1
    offsets = np.cumsum(lengths) - lengths
    return mixed(np.add.reduceat(own * keys(int(lengths.max()))[np.arange(len(own)) - np.repeat(offsets, lengths)], offsets))


def keys(n: int) -> np.ndarray:
    """A random factor for each place in a word. Powers of one base would make words of 1,024 letters collide that are built for it."""
    if len(_KEYS[0]) < n:
        _KEYS[0] = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * ODD) | np.uint64(1)
    return _KEYS[0]


_KEYS = [np.empty(0, np.uint64)]


def normal(data: bytes) -> bytes:
    return b" ".join(data.split())  # bytes.split() cuts at the six white characters alone


def begins(data: bytes) -> np.ndarray:
    """Where each word of normal bytes begins, and one past the end."""
    if not data:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1, [len(data) + 1]])


def window_numbers(codes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Equal numbers for equal windows of `length` codes."""
    numbers, depth = codes, 1
    while depth < length:
        step = min(depth, length - depth)
        pair = numbers[:-step] * (int(numbers.max()) + 1) + numbers[step:]
        numbers = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth += step
    return numbers


def compare(strings: list[bytes], times: np.ndarray, first: np.ndarray, repeats: str, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the windows that also stand in one of a smaller first id."""
    words = [s.split(b" ") for s in strings]
    sizes = np.array([len(w) for w in words])
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in chain.from_iterable(words)], np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return [np.zeros(0, bool)] * len(strings)
    owner = np.repeat(np.arange(len(strings)), windows)
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begins[owner]
    mine = window_numbers(codes, length)[at]
    order = np.argsort(mine, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], mine[order][1:] != mine[order][:-1]]))
    least = np.minimum.reduceat(first[owner][order], starts)
    smallest = np.empty(len(mine), np.int64)
    smallest[order] = np.repeat(least, np.diff(starts, append=len(mine)))
    flags = smallest < first[owner]
    return np.split(flags, list(accumulate(windows))[:-1])


WORDS = Kind(LENGTH, MINIMISER, normal, word_hashes, begins, compare)


def spans_of(docs: DataFrame, id_column: str, text_column: str, hot: int) -> DataFrame:
    return repeated_spans(docs, WORDS, SMALLER, id_column=id_column, text_column=text_column, hot=hot)


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT, keep: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of each row; with `keep` also the remaining words, joined by a space."""
    spans = spans_of(docs, id_column, text_column, hot)
    joined, _ = with_spans(docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")), spans, "id", "text")

    names, types = ["n_words", "n_removed", "kept_sha256", "kept"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
    width = 3 + keep

    def run(batches):
        for batch in few_rows(batches):
            rows = []
            for text, own in zip(batch.column(1).to_pylist(), span_arrays(batch.column(2))):
                words = text.encode().split()
                kept = words
                if own:
                    gone = covered_units(len(words), own).tolist()
                    kept = [w for w, g in zip(words, gone) if not g]
                data = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), data))
            columns = [pa.array([r[c].decode() for r in rows] if c == 3 else [r[c] for r in rows], types[c]) for c in range(width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names[:width]])

    id_type = joined.schema["id"].dataType.simpleString()
    out = joined.select("id", "text", "_spans").transform(in_batches, run, f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep)
    return out.withColumnRenamed("id", id_column)


def kept_bytes(data: bytes, gone: np.ndarray) -> bytes:
    """data without the flagged words and the white space after each of them."""
    word = ~BLANK[np.frombuffer(data, np.uint8)]
    number = np.cumsum(word & ~np.concatenate([[False], word[:-1]])) - 1  # the word that a byte stands in or after
    return np.frombuffer(data, np.uint8)[(number < 0) | ~gone[number]].tobytes()


def without_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", hot: int = HOT) -> DataFrame:
    """docs with repeated words gone from their texts, the white space of the others as it was; a text that loses none stays as it is, all other columns too."""
    joined, column = with_spans(docs, spans_of(docs, id_column, text_column, hot), id_column, text_column)
    place, spans = docs.columns.index(text_column), len(docs.columns)

    def run(batches):
        for batch in few_rows(batches):
            texts = batch.column(place).to_pylist()
            for i, own in enumerate(span_arrays(batch.column(spans))):
                if own:
                    data = texts[i].encode()
                    texts[i] = kept_bytes(data, covered_units(len(data.split()), own)).decode()
            columns = batch.columns[:spans]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:spans]))

    return joined.select(*docs.columns, column).transform(in_batches, run, docs.schema)
