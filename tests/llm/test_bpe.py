"""Operator 11 against the tokenizers library and against merging by rescanning."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from civicspark.llm import bpe
from civicspark.llm.bpe import Bpe, encoded, merged, vocabulary


@pytest.fixture(scope="module")
def own():
    return Bpe(vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def same(own, library, text):
    ids = own.encode(text).tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


PIECES = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'ll", "'", "1", "é", "\x1c", "\x85", "<|endoftext|>", "<|endo", "!", "世", "　", "​", "🙂", "ﬁ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join) | st.text(max_size=40))
def test_ids_are_those_of_the_library(own, library, text):
    same(own, library, text)


def test_every_letter_of_the_first_plane(own, library):
    for low in range(0, 0x10000, 512):
        same(own, library, "".join(f"a{chr(c)}b1{chr(c)}  {chr(c)}!" for c in range(low, low + 512) if not 0xD800 <= c < 0xE000))


def test_very_long_words_and_texts(own, library):
    same(own, library, "a" * 100_000 + " " * 1000 + "é" * 50_000 + "ab <|endoftext|>  " * 40_000 + "x y " * 100_000)


def test_small_tables_of_words_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 4)
    fresh = Bpe(vocabulary())
    same(fresh, library, "one two three four five six seven one two three one one " * 3)
    assert len(fresh.word) <= 4 and len(fresh.after_blank) <= 4


@given(st.lists(st.integers(0, 3), max_size=30))
def test_queue_and_links_against_rescanning(symbols):
    pairs = [(0, 1), (4, 0), (2, 2), (5, 3), (6, 6), (4, 4), (3, 4)]
    ranks = [{} for _ in range(12)]
    for rank, (a, b) in enumerate(pairs):
        ranks[a][b] = rank
    want = list(symbols)
    while True:
        found = [(pairs.index(p), i) for i, p in enumerate(zip(want, want[1:])) if p in pairs]
        if not found:
            break
        rank, at = min(found)
        want[at : at + 2] = [4 + rank]
    assert merged(symbols, ranks, [4 + k for k in range(len(pairs))]) == want


def test_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (None, "He said 'it's'", "z"), (2, "Hi  there", "z"), (2, "Hi  there", "z"), (4, "w " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in encoded(docs, vocabulary()).collect()), key=repr)
    assert got == sorted(((k, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t, _ in rows), key=repr)
    assert encoded(docs.limit(0), vocabulary()).count() == 0


def test_query_digests(spark, small, library):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    rows = bpe.op11_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
