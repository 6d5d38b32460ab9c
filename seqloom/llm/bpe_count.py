"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

The tokenizer file gives the pattern that cuts a text into pieces, the merge ranks and the
word-end mark. A piece starts as its bytes; the adjacent pair of the lowest rank is merged again and
again; the count is the number of bytes less the number of merges.

Defined results: a null or empty text, and one of white space only, has no tokens; special strings in
a text (such as <|endoftext|>) count one each, as the tokenizer's own library does by default; very
long texts are walked word by word; equal texts get equal counts; columns of the input other than
the two that are named don't matter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import WHITE, Memo, in_batches, text_or_empty

NOT_SPACE = re.compile(f"[^{WHITE}]+")
ODD_SPACE = re.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts the tokens of a text for one tokenizer file.

    pieces and words bound how many distinct pieces and words are remembered.
    """

    def __init__(self, path: str, words: int = 700_000, pieces: int = 700_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.steps = {n["type"]: n for n in (spec["normalizer"] or {}).get("normalizers", [])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left, right) -> (rank, merged)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        end, letters = model["end_of_word_suffix"] or "", byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.piece_count = Memo(self.count_piece, pieces)
        self.word_count = Memo(self.count_word, words)

    def count_piece(self, piece: str) -> int:
        """Initial symbols less merges."""
        data = piece.encode()
        symbol = [self.inner[b] for b in data]
        symbol[-1] = self.last[data[-1]]
        n, merges = len(symbol), self.merges
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(*m, i) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            rank, merged, i = heapq.heappop(heap)
            j = right[i]
            if symbol[i] < 0 or j >= n or merges.get((symbol[i], symbol[j]), (-1,))[0] != rank:
                continue  # one of the two has gone into another merge
            symbol[i], symbol[j] = merged, -1
            count -= 1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if m := merges.get((merged, symbol[k])):
                    heapq.heappush(heap, (*m, i))
            if (h := left[i]) >= 0 and (m := merges.get((symbol[h], merged))):
                heapq.heappush(heap, (*m, h))
        return count

    def normal(self, text: str) -> str:
        if "NFC" in self.steps:
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a sigma at a word's end is no exception
        return text.replace("Σ", "σ").lower() if "Lowercase" in self.steps else text

    def count_word(self, word: str) -> int:
        if self.special.search(word):
            plain = self.special.split(word)
            return len(plain) - 1 + sum(self.count_word(x) for x in plain if x)
        return sum(map(self.piece_count.__getitem__, self.pattern.findall(self.normal(word))))

    def __call__(self, text: str) -> int:
        words = NOT_SPACE.findall(text) if ODD_SPACE.search(text) else text.split()
        return sum(map(self.word_count.__getitem__, words))


@functools.cache
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; one pass, nothing is shuffled."""

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            n = [count(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    text = text_or_empty(text_column)
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = rows.transform(in_batches, run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
