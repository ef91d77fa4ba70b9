import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opslattice.llm import token_counts
from opslattice.llm.queries import QUERIES, WORD_VOCABULARY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORD_VOCABULARY)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def proven():
    return token_counts.proven_tokens(WORD_VOCABULARY)


@pytest.fixture(scope="module")
def count(proven):
    counter = token_counts.Counter(WORD_VOCABULARY, proven)
    return lambda text: next(counter([text]))


def test_proven_tokens_are_one_token_everywhere(library, proven):
    some = sorted(proven, key=lambda p: (len(p), p))
    assert len(some) > 30_000 and "the" in some and "ing" in some
    for piece in random.Random(1).sample([p for p in some if p.isascii() and p.isalpha()], 500):
        assert library(piece) == 1 and library(f"{piece} {piece}, {piece}") == 4
    assert "it's" not in proven and "12" not in proven and "two words" not in proven and "Upper" not in proven


ALPHABET = st.sampled_from(list("abAsStTdmlrevV09'’.,-_ \t\n\x0b\x1c\x1f\x85\xa0 　\0́̈éÉßΣσςİıǅﬁ½²日本٣क्षि😀<|>"))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(ALPHABET, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'ve", "hello", "ΣΑΣ", " "]))).map("".join))
def test_counts_equal_the_library(library, count, text):
    assert count(text) == library(text)


def test_long_and_odd_texts(library, count):
    for text in ["", "x" * 30_000, "ab " * 20_000, "'" * 999, "1234567890" * 50, "<|endoftext|>" * 20, "é" * 5_000, "don't you'll I've they're"]:
        assert count(text) == library(text)
    assert count(None) == 0


def test_bounded_memory(library, proven, monkeypatch):
    monkeypatch.setattr(token_counts, "_GENERATION", 50)
    counter, rng = token_counts.Counter(WORD_VOCABULARY, proven), random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeéXYZ.'") for _ in range(rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    assert list(counter(texts)) == [library(t) for t in texts]
    assert len(counter._young) <= 50 + 40 and len(counter._old) <= 50 + 40


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op11_token_counts"](spark, FOLDER)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {
        i: (len((t or "").encode()), library(t), library(t) > 2048) for i, t in texts.items()}


def test_rough_rows(spark, rough, nothing, library):
    got = token_counts.token_counts(rough, WORD_VOCABULARY, limit=40)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = [(r["doc_id"], len((r["text"] or "").encode()), library(r["text"]), library(r["text"]) > 40) for r in rough.collect()]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert token_counts.token_counts(nothing, WORD_VOCABULARY).collect() == []
