from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from tessera.llm import bpe, token_counts
from tests.conftest import DATA

UNIGRAM = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def fuzz(n: int = 1500) -> list[str]:
    rng = random.Random(7)
    some = " \n\tabe<>/s0xA▁éß日本語😀 the 1'\x85\xa0²½_-"
    return ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(n)] + ["", " ", "a" * 3000, " " * 700 + "x", "<|endoftext|>x <|endoftext|>", "՘՘ a֋", "\x1c\x1d x"]


def library_unigram():
    t = Tokenizer(models.Unigram(token_counts.vocabulary(UNIGRAM), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_viterbi_counts_equal_the_library():
    texts = fuzz()
    counter = token_counts.Counter(token_counts.vocabulary(UNIGRAM))
    assert [counter.text(t) for t in texts] == [len(e.ids) for e in library_unigram().encode_batch(texts, add_special_tokens=False)]
    assert counter.text(None) == 0


def test_viterbi_ties_and_unknowns():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -3.0), ("▁a", -2.0)]
    lib = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(pieces)
    for text in ("ab", "ab ab", "abab", "aéé b", "éé", "b"):
        assert counter.text(text) == len(lib.encode(text, add_special_tokens=False).ids), text


def test_token_counts_query(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in token_counts.query(spark, f"{DATA}/sf0.001").collect()}
    want = library_unigram().encode_batch([r.text for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: len(e.ids) for r, e in zip(rows, want, strict=True)}


def test_token_counts_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, "", 9), (None, "the", 9), (2, "the the", 9), (2, "the the", 9)], "doc_id long, text string, n_tokens long")
    got = token_counts.token_counts(df, token_counts.vocabulary(UNIGRAM))
    assert got.columns == ["doc_id", "n_tokens"]
    one, two = (len(library_unigram().encode(t, add_special_tokens=False).ids) for t in ("the", "the the"))
    assert sorted(((r.doc_id or 0), r.n_tokens) for r in got.collect()) == [(0, one), (1, 0), (1, 0), (2, two), (2, two)]
    assert token_counts.token_counts(df.limit(0), token_counts.vocabulary(UNIGRAM)).count() == 0


@pytest.fixture(scope="module")
def tables():
    return bpe.Tables(BPE)


def test_bpe_equals_the_library_and_comes_back(tables):
    texts = fuzz() + [f"{chr(a)}{b} {chr(a)}" for a in range(1, 256) for b in " a1'."]
    lib = Tokenizer.from_file(BPE)
    words = [" the", " of", "the", " and", " über", " thonble"]
    for coder in (bpe.Coder(tables), bpe.Coder(tables, bpe.compiled_lexicon(tables, words))):
        got = coder.encode_all(texts)
        want = lib.encode_batch(texts, add_special_tokens=False)
        assert got == [np.array(e.ids, "<u4").tobytes() for e in want]
        assert [coder.decode(x) for x in got] == [lib.decode(e.ids, skip_special_tokens=False) for e in want]


def test_memo_starts_anew(tables, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 5)
    coder = bpe.Coder(tables)
    texts = ["a b c d e f g h", "i j k a b", "a"]
    assert coder.encode_all(texts) == bpe.Coder(tables).encode_all(texts)


def test_transducer_shares_suffixes_and_numbers_words(tables):
    words = sorted({f"{a}{b}ing".encode() for a in "abcdefgh" for b in "xyz"} | {b"a", b"ab", b"zing"})
    lex = bpe.Lexicon.compiled({w: tables.merge(w) for w in words})
    assert len(lex.final) < 15  # a trie has over 90
    lex = bpe.Lexicon.mapped(*lex.dumped())
    assert lex.numbers(words).tolist() == list(range(len(words)))
    assert (lex.numbers([b"", b"q", b"axin", b"axingg", b"x" * 99]) == -1).all()
    assert bpe.Lexicon.compiled({}).numbers([b"a"]).tolist() == [-1]


def test_frequent_words_are_the_most_frequent(spark):
    df = spark.createDataFrame([("x the the cat the",), ("a cat the",), (None,)], "text string")
    assert bpe.frequent_words(df, least=1, most=2) == [" the", " cat"]


def test_bpe_query_and_odd_rows(spark):
    lib = Tokenizer.from_file(BPE)
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "héllo <|endoftext|>", 3), (3, "héllo <|endoftext|>", 3), (None, "x", 4)], "doc_id long, text string, ids int")
    got = bpe.encode_decode(df, BPE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in got) == sorted([(1, 0, ""), (2, 0, ""), (0, 1, "x"), *[(3, len(lib.encode("héllo <|endoftext|>").ids), "héllo <|endoftext|>")] * 2])
    assert bpe.encode_decode(df.limit(0), BPE).count() == 0
    rows = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    out = {r.doc_id: r for r in bpe.query(spark, f"{DATA}/sf0.001").collect()}
    for r, e in zip(rows, lib.encode_batch([r.text for r in rows], add_special_tokens=False), strict=True):
        assert out[r.doc_id].n_tokens == len(e.ids)
        assert out[r.doc_id].ids_sha256 == sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert out[r.doc_id].decoded_sha256 == sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_together_equal_words_one_by_one():
    rng = np.random.default_rng(2)
    letters = list("abcé的😀")
    word = lambda n: "".join(rng.choice(letters, n))
    for with_bytes in (False, True):
        pieces = {word(int(rng.integers(1, 6))): -float(rng.integers(1, 6)) for _ in range(60)} | {"a": -2.0, "aa": -4.0, "": -1.0}
        if with_bytes:
            pieces |= {f"<0x{b:02X}>": -9.0 for b in range(256)}
        c = token_counts.Counter(list(pieces.items()))
        asked = [word(int(rng.integers(0, 40))) for _ in range(500)] + ["a" * 400, "", "b\n"]
        assert c.words(asked) == [c.word(w) for w in asked]
