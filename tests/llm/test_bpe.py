import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe as B
from tests.llm.util import corpus, documents


@pytest.fixture(scope="module")
def pair():
    with open(B.vocabulary_path(), encoding="utf-8") as f:
        return B.Codec(f.read()), Tokenizer.from_file(B.vocabulary_path())


def same(pair, text):
    codec, library = pair
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids, repr(text[:60])
    assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(pair):
    for t in ["", " ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "  \x1c\x1d\x85  x", "naïve 你好 😀", "x" * 700, "ab" * 300 + " " * 60, "don't I'LL we've", "¼ ½²", "\r\n\t \x00\x01 end ", "\n\n\n   a"]:
        same(pair, t)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(pair, text):
    same(pair, text)


def test_long_words_use_the_same_merges(pair, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 90))) for _ in range(200)]
    short = [pair[0].merge(w.encode()) for w in words]
    monkeypatch.setattr(B, "SHORT", 1)
    assert [pair[0].merge(w.encode()) for w in words] == short


def test_bounded_memory(pair, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    with open(B.vocabulary_path(), encoding="utf-8") as f:
        small = B.Codec(f.read())
    text = " ".join(f"w{i % 11}" for i in range(200))
    assert small.encode(text) == pair[0].encode(text) and len(small.new) <= 3 and len(small.old) <= 3


def test_table(spark, pair):
    rows = corpus(9, 30)
    out = {r.doc_id: r for r in B.round_trip(spark, documents(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        ids = np.array(pair[1].encode(t or "", add_special_tokens=False).ids, "<u4")
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    full = B.encode(spark, documents(spark, rows))
    assert full.columns == [*documents(spark, []).columns, "ids"] and full.where("text is null").first().ids == []
    assert B.round_trip(spark, documents(spark, [])).count() == 0


def test_very_long_words_and_repeated_rows(spark, pair):
    rng = random.Random(2)
    long = "".join(rng.choice("etaoinsh") for _ in range(2_000_000))
    rows = [(1, long), (2, "a b"), (2, "a b"), (2, "c"), (3, " " * 1_000_000), (4, "word " * 300_000)]
    out = B.round_trip(spark, documents(spark, rows)).collect()
    assert len(out) == 6 and len({(r.n_tokens, r.ids_sha256) for r in out if r.doc_id == 2}) == 2
    for i, t in rows:
        if i != 2:
            ids = np.array(pair[1].encode(t, add_special_tokens=False).ids, "<u4")
            assert [r.ids_sha256 for r in out if r.doc_id == i] == [hashlib.sha256(ids.tobytes()).hexdigest()]
