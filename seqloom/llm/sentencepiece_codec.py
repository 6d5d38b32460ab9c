"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces walks the text once. At each position its output links give every piece
that ends there, longest first, and each relaxes the best score of the position by that of the path at its start and its own.
For unigram models all paths count. In a BPE model the highest sum of scores isn't what the library gives (a test has the
counter-examples): there a piece may follow a path's last piece only if the two, side by side, would not have been merged otherwise. The
best of those paths has the library's own ids.

Defined results: a null or empty text has no ids; the dummy space before a text is dropped in decoding;
a character in no piece becomes its bytes; equal texts get equal ids; texts of any length are walked word
by word; other columns don't matter.
"""

from __future__ import annotations

import functools
import gc
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import Memo, Recent, in_batches, remember, text_or_empty

SPACE = "▁"
BPE = 2
NEVER = float("-inf")
#: What a character in no piece costs in a model of scores.
UNKNOWN = -1e6
#: Words whose ids a worker keeps.
REMEMBERED = 800_000
#: Steps of the automaton along failure links that are remembered.
REMEMBERED_STEPS = 200_000


class Automaton:
    """Aho-Corasick over pieces; `step` is the goto function with failures followed on demand."""

    def __init__(self, pieces: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.fail, self.piece, size = [0], [-1], [0]
        for text, piece in pieces.items():
            node = 0
            for c in text:
                if (child := self.goto[node].get(c)) is None:
                    child = self.goto[node][c] = len(self.fail)
                    self.goto.append({})
                    self.fail.append(0)
                    self.piece.append(-1)
                    size.append(size[node] + 1)
                node = child
            self.piece[node] = piece
        #: Nearest node along the failure links at which a piece ends; 0: none.
        self.output = [0] * len(self.fail)
        queue = deque(self.goto[0].values())
        while queue:
            node = queue.popleft()
            f = self.fail[node]
            self.output[node] = f if self.piece[f] >= 0 else self.output[f]
            for c, child in self.goto[node].items():
                self.fail[child] = self.step(f, c)
                queue.append(child)
        #: Of each node: (piece, length) of all that end there, longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = []
        for node, piece in enumerate(self.piece):
            found, at = [], node if piece >= 0 else self.output[node]
            while at:
                found.append((self.piece[at], size[at]))
                at = self.output[at]
            self.ends.append(tuple(found))
        #: Steps along failure links that may still be remembered.
        self.room = REMEMBERED_STEPS

    def step(self, node: int, c: str) -> int:
        while (child := self.goto[node].get(c)) is None:
            if not node:
                return 0
            node = self.fail[node]
        return child


    def move(self, node: int, c: str) -> int:
        """step, remembered in goto as long as there is room."""
        child = self.step(node, c)
        if child and self.room:
            self.room -= 1
            self.goto[node][c] = child
        return child


class SentencePieceCodec:
    """ids of texts and texts of ids for one .model file; `remembered` bounds the words whose ids are kept."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        with open(path, "rb") as f:
            model = ModelProto.FromString(f.read())
        self.bpe = model.trainer_spec.model_type == BPE
        self.dummy = model.normalizer_spec.add_dummy_prefix
        self.unknown = model.trainer_spec.unk_id
        self.library = SentencePieceProcessor(model_file=path)  # only asked for byte pieces and names
        kinds = type(model.pieces[0])
        self.score = [p.score for p in model.pieces]
        self.text = [p.piece for p in model.pieces]
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.pieces = plain
        self.automaton = Automaton({p: i for p, i in plain.items() if p.strip(SPACE) or len(p) == 1})
        #: Of each node of the automaton: (piece, length, score) of all that end there, longest first.
        self.ends = [tuple((piece, n, self.score[piece]) for piece, n in own) for own in self.automaton.ends]
        self.decoded = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.byte.items():
            self.decoded[i] = bytes([b])
        for i, p in enumerate(model.pieces):
            if p.type == kinds.CONTROL:
                self.decoded[i] = b""
            elif p.type == kinds.UNKNOWN:
                self.decoded[i] = " ⁇ ".encode()
        if any(SPACE in p[1:] and p.strip(SPACE) for p in plain) or any("\n" in p for p in plain):
            raise ValueError("a piece holds a space within or a line end: texts of this model can't be walked word by word")
        #: Neighbours within some piece; between any other two characters no piece can lie, so a word may be cut there.
        self.joined = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}
        #: Words share their parts, as with and without a comma.
        self.parts = Recent(lambda part: tuple(self.viterbi(part)), remembered * 3 // 8)
        # words are kept with plain spaces: strings of Latin letters alone take half the memory
        self.words = re.compile(" *[^ \n]+|\n| +")
        self.size = len(self.text)
        #: Whether pieces a and b can stand side by side, under a * size + b.
        self.compatible = Recent(lambda pair: self._compatible(divmod(pair, self.size)), 400_000)
        self.split = Memo(self._split, 100_000)
        self.turn = Memo(self._turn, 100_000)
        self.runs = Memo(self._run, 10_000)
        self.ids = Recent(lambda w: np.array(self.word_ids(w.replace(" ", SPACE)), "<i4").tobytes(), remembered)

    def _split(self, piece: int) -> tuple[int, int] | None:
        """The two parts whose merge makes a piece; None for a single character."""
        text = self.text[piece]
        cuts = ((self.pieces.get(text[:k]), self.pieces.get(text[k:])) for k in range(1, len(text)))
        return next((p for p in cuts if None not in p and self._compatible(p, piece)), None)

    def _turn(self, piece: int) -> float:
        """The score at whose turn a piece is there: its own, or a lower one of a part that it waits for."""
        parts = self.split[piece]
        return min(self.score[piece], self.turn[parts[0]], self.turn[parts[1]]) if parts else float("inf")

    def _compatible(self, pair: tuple[int, int], whole_piece: int = -1) -> bool:
        """Whether two pieces side by side stay as they are, but for becoming whole_piece: no merge across their border comes before the merges that make them."""
        lefts, rights = [pair[0]], [pair[1]]  # the pieces at the border, back to single characters
        while parts := self.split[lefts[-1]]:
            lefts.append(parts[1])
        while parts := self.split[rights[-1]]:
            rights.append(parts[0])
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            left = self.turn[lefts[i - 1]] if i else NEVER
            right = self.turn[rights[j - 1]] if j else NEVER
            whole = self.pieces.get(self.text[lefts[i]] + self.text[rights[j]])
            # of merges with one score the left one comes first
            if whole not in (None, whole_piece) and self.score[whole] > left and self.score[whole] >= right:
                return False
            if not i and not j:
                return True
            if left >= right:
                i -= 1
            else:
                j -= 1

    def viterbi(self, text: str) -> list[int]:
        """The piece ids of text (a word with its spaces as ▁)."""
        last, size = self.best_bpe(text) if self.bpe else self.best_unigram(text)
        path, i = [], len(text)
        while i:
            at = i - size[i]
            path.append((last[i], text[at:i]))
            i = at
        return [x for piece, own in reversed(path) for x in ((piece,) if piece >= 0 else self.fallback(own))]

    def best_bpe(self, text: str) -> tuple[list[int], list[int]]:
        """Of each position the last piece of its best path and that piece's length; -1: nothing before, or a character in no piece.

        The best path is that of the highest sum of scores among the paths of which BPE would leave all neighbours side by side.
        """
        goto, move, ends, compatible, pieces = self.automaton.goto, self.automaton.move, self.ends, self.compatible, self.size
        best, last, size, node = [0.0] * (len(text) + 1), [-1] * (len(text) + 1), [1] * (len(text) + 1), 0
        for i, c in enumerate(text, 1):
            node = goto[node].get(c) or move(node, c)
            top = NEVER
            for piece, n, score in ends[node]:
                at = i - n
                # only a better path is asked whether its pieces can be neighbours
                if (s := best[at] + score) > top and ((before := last[at]) < 0 or compatible[before * pieces + piece]):
                    top, last[i], size[i] = s, piece, n
            best[i] = top if last[i] >= 0 else best[i - 1]
        return last, size

    def best_unigram(self, text: str) -> tuple[list[int], list[int]]:
        """The same for a model of scores: the path of the highest sum."""
        goto, step, ends, score = self.automaton.goto, self.automaton.step, self.automaton.ends, self.score
        best, last, size, node = [0.0], [-1], [0], 0
        for i, c in enumerate(text, 1):
            node = goto[node].get(c) or step(node, c)
            top, own, length = best[i - 1] + UNKNOWN, -1, 1
            for piece, n in ends[node]:
                if (s := best[i - n] + score[piece]) > top:
                    top, own, length = s, piece, n
            best.append(top)
            last.append(own)
            size.append(length)
        return last, size

    def fallback(self, text: str) -> list[int]:
        return [self.byte[b] for b in text.encode()] if self.byte else [self.unknown]

    def _run(self, n: int) -> list[int]:
        """Pieces of n spaces in a row: merged in pairs from the left, all such merges being of one rank."""
        symbols = [SPACE] * n
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                if (p := self.pieces.get(symbols[i] + symbols[i + 1])) is not None and (best is None or self.score[p] > best):
                    best, at = self.score[p], i
            if at < 0:
                return [self.pieces[s] for s in symbols]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def cut(self, word: str) -> list[str]:
        """A word's parts that no piece crosses."""
        joined, parts, at = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        return parts

    def word_ids(self, word: str) -> list[int]:
        spaces = len(word) - len(word.lstrip(SPACE))
        if self.bpe and spaces == len(word):
            return self.runs[spaces]
        extra = spaces - 1 if self.bpe and spaces > 1 else 0
        parts = self.cut(word[extra:])
        own = [x for part in parts for x in self.parts[part]]
        if not extra:
            return own
        alone = own[0] == self.pieces[SPACE]
        return [*self.runs[spaces - (not alone)], *own[alone:]]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        whole = " " * self.dummy + text.replace(SPACE, " ")
        return np.frombuffer(b"".join(map(self.ids.__getitem__, self.words.findall(whole))), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


@functools.cache
def codec(path: str, remembered: int = REMEMBERED) -> SentencePieceCodec:
    made = SentencePieceCodec(path, remembered)
    gc.freeze()  # the automaton stays: collections needn't go through it
    remember(__name__, forget_codecs)
    return made


def forget_codecs() -> None:
    """Frees all codecs of this process with the words that they remember."""
    codec.cache_clear()
    gc.unfreeze()
    gc.collect()


def encode_documents(docs: DataFrame, model: str, *, id_column: str = "doc_id", text_column: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """id, ids, n_ids and whether decoding gives the text back (▁ in a text reads as a space). remembered: words whose ids a worker keeps; there may be more workers than cores."""

    def run(batches):
        sp = codec(model, remembered)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [sp.encode(x) for x in texts]
            same = [sp.decode(i) == x.replace(SPACE, " ") for i, x in zip(ids, texts)]
            sizes = [len(i) for i in ids]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())
            values = pa.array(np.concatenate([*ids, np.empty(0, "<i4")]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["id", "ids", "n_ids", "round_trip"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text"))
    return rows.transform(in_batches, run, f"id {kind}, ids array<int>, n_ids long, round_trip boolean").withColumnRenamed("id", id_column)


def decode_documents(encoded: DataFrame, model: str, *, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """id and text of encoded rows; null ids decode to the empty text."""

    def run(batches):
        sp = codec(model)
        for batch in batches:
            texts = [sp.decode(np.array(x or [], "<i4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids")).transform(in_batches, run, f"id {kind}, text string").withColumnRenamed("id", id_column)
