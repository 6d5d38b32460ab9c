"""Codec, token files and token counts against the tokenizers' own libraries."""

import random
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from seqloom.llm.common import Recent, forget_others, in_batches
from seqloom.llm import bitplane_tokens, bpe_count, sentencepiece_codec

SPECIAL = "<|endoftext|>"


def random_texts(n, seed=7):
    rng = random.Random(seed)
    letters = list(" \n\tabcXé.,!?()'-_»–<|>12½日\x1c\x85　▁Σİ") + [SPECIAL, " word", "'s", "'t", "the ", "  ", "\r\n"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 20))) for _ in range(n)]


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [(5, None, "x"), (1, "", "x"), (2, "Hello  world\nfoo  ", None), (3, "word " * 30_000, "x"), (4, "Hello  world\nfoo  ", "x"), (4, "Hello  world\nfoo  ", "x"), (None, f"a {SPECIAL} b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string").selectExpr("*", "id AS n_tokens")


@pytest.fixture(scope="module")
def real_texts(spark, sf_dir):
    return [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_sentencepiece_gives_the_library_ids(real_texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = sentencepiece_codec.SentencePieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in [*random_texts(1500), *real_texts, "a" * 3000, " " * 50]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), text[:50]
        assert own.decode(ids) == text.replace("▁", " ") or "�" in text


def test_sums_of_scores_alone_do_not_give_bpe_ids(real_texts):
    """Why a piece of a BPE model may not follow every other one."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)

    class Sums(sentencepiece_codec.SentencePieceCodec):
        def best_bpe(self, text):
            return self.best_unigram(text)

    own, sums, unlike = sentencepiece_codec.SentencePieceCodec(path), Sums(path), 0
    for word in sorted({w for t in real_texts[:60] if t for w in t.split()})[:2000]:
        assert own.encode(word).tolist() == library.encode(word)
        unlike += sums.encode(word).tolist() != library.encode(word)
    assert unlike


def test_unigram_viterbi_is_the_best_of_all_ways():
    class Small(sentencepiece_codec.SentencePieceCodec):
        def __init__(self):
            self.bpe, self.unknown, self.byte = False, 0, {}
            self.score = [0.0, -2.0, -2.5, -3.0, -1.0, -4.1]
            self.automaton = sentencepiece_codec.Automaton({"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5})

    def best(text):
        if not text:
            return 0.0, ()
        names = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5}
        return max((score + c.score[p], (p, *rest)) for t, p in names.items() if text.startswith(t) for score, rest in [best(text[len(t) :])])

    c = Small()
    for n in range(1, 9):
        for k in range(2**n):
            text = f"{k:0{n}b}".replace("0", "a").replace("1", "b")
            score, _ = best(text)
            assert sum(c.score[p] for p in c.viterbi(text)) == pytest.approx(score)


def test_encode_and_decode_documents(spark, edge_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_codec.encode_documents(edge_docs, path)
    rows = out.collect()
    assert len(rows) == 7 and all(r["round_trip"] for r in rows)
    assert {r["n_ids"] for r in rows if r["doc_id"] in (1, 5)} == {0}
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode_documents(out, path).collect()}
    assert back[3] == "word " * 30_000 and back[1] == ""
    assert sentencepiece_codec.encode_documents(edge_docs.limit(0), path).count() == 0


def test_token_counts(spark, edge_docs, real_texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = bpe_count.MergeCounter(path), Tokenizer.from_file(path)
    for text in [*random_texts(1500), *real_texts, "x" * 4000]:
        assert own(text) == len(library.encode(text, add_special_tokens=False).ids), text[:50]
    rows = bpe_count.count_tokens(edge_docs, path).collect()
    assert len(rows) == 7 and rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit"}
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["over_limit"] and by[1]["n_tokens"] == by[5]["n_tokens"] == 0 and by[None]["n_tokens"] == 3
    assert bpe_count.count_tokens(edge_docs.limit(0), path).count() == 0


def test_forgetting_changes_nothing(real_texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    small, large = bpe_count.MergeCounter(path, 50, 50), bpe_count.MergeCounter(path)
    assert [small(t) for t in real_texts[:40]] == [large(t) for t in real_texts[:40]]
    path = public_tokenizers.path("byte_bpe_50k.json")
    small, large = bitplane_tokens.Encoder(path, 50), bitplane_tokens.Encoder(path)
    assert [small(t) for t in real_texts[:40]] == [large(t) for t in real_texts[:40]]


def test_encoder_gives_the_library_ids(real_texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bitplane_tokens.Encoder(path), Tokenizer.from_file(path)
    for text in [*random_texts(3000), *real_texts]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_planes():
    for n in (1, 7, bitplane_tokens.BLOCK, bitplane_tokens.BLOCK + 1):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32).astype("<u4")
        sizes, payload = bitplane_tokens.pack(ids)
        assert (bitplane_tokens.unpack(sizes, payload, n) == ids).all()


def test_token_files(spark, edge_docs, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path, out = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t")
    library = Tokenizer.from_file(path)
    bitplane_tokens.write_token_files(edge_docs, path, out, shards=3)
    got = sorted(map(tuple, bitplane_tokens.read_documents(spark, out).collect()), key=lambda r: r[1])
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in edge_docs.collect()))
    start, expected = 0, []
    for known, doc_id, text in texts:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    index = bitplane_tokens.chunk_index(spark, out).orderBy("start").collect()
    assert index[0]["start"] == 0 and sum(r["n_ids"] for r in index) == start and sum(r["n_docs"] for r in index) == 7
    bitplane_tokens.write_token_files(edge_docs.limit(0), path, out)
    assert bitplane_tokens.read_documents(spark, out).count() == 0


def test_recent_values_stay():
    made = []
    memo = Recent(lambda k: made.append(k) or 2 * k, 10)
    for k in range(1000):
        assert memo[k] == 2 * k and memo[-1] == -2
        assert len(memo) + len(memo.before) <= 10
    # what is asked for all the time is made once, what isn't is forgotten
    assert made.count(-1) == 1 and memo[0] == 0 and made.count(0) == 2


def test_tasks_of_other_operators_free_remembered_words(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sentencepiece_codec.codec.cache_info().currsize] * batch.num_rows, pa.int64())], ["n"])

    for _ in range(3):
        assert sentencepiece_codec.encode_documents(docs, path).first()["n_ids"] > 0
        assert in_batches(docs, held, "n long").first()["n"] == 0
    # all of it goes, in spite of its cycles and of gc.freeze
    one = weakref.ref(sentencepiece_codec.codec(path))
    assert one().encode("some words").size
    forget_others(sentencepiece_codec.__name__)
    assert one() is not None
    forget_others("another")
    assert one() is None
