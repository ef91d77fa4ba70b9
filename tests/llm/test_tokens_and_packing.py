import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from opslattice.llm import packing, tokens
from opslattice.llm.encoding import Encoder
from opslattice.llm.queries import QUERIES, VOCABULARY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    return Encoder(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab ZÀñøɏŁ9.,'\n\t\r\x0b\x1c\x1f\x85\xa0᠎ 　éß日́😀|<>\0s"), max_size=30), max_size=5))
def test_word_by_word_equals_whole_texts(plain, words, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in words(texts)] == [plain(t) for t in texts]


def test_special_tokens_and_nulls(plain, words):
    texts = [None, "", "<|endoftext|> and <|endoftext|>", "a  <|endoftext|> b", "a<|endoftext|>", "don't you'll  I've", "x" * 3000 + " y",
             " word,;--. (word) word's word_a [x] `y` ~z^ a", "\nword word\nword,\n word\n", "word !? ...", "Ġword ġ"]
    assert [np.frombuffer(b, "<u4").tolist() for b in words(texts)] == [plain(t) for t in texts]


def test_vocabulary_is_not_copied():
    assert VOCABULARY == public_tokenizers.path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_store_against_plain_encoding(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    expected, start = {}, 0
    for i in sorted(texts):
        ids = plain(texts[i]) + [2]
        expected[i] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op8_token_store"](spark, FOLDER).collect()}
    assert got == expected


def test_store_of_rough_rows_and_single_documents(spark, rough, nothing, plain):
    folder = tokens.store(rough, VOCABULARY)
    got = tokens.read_store(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rough.collect())
    expected = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in rough.collect())
    start = 0
    for r, (_, _, _, text) in zip(sorted(got, key=lambda r: r["start"]), expected):
        ids = plain(text) + [2]
        assert (r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (start, ids)
        start += len(ids)
    some = tokens.fetch(spark, folder, spark.createDataFrame([(3,), (7,), (99,)], "doc_id long")).collect()
    assert {r["doc_id"]: len(r["ids"]) // 4 for r in some} == {3: 1, 7: len(plain(expected[[e[1] for e in expected].index(7)][3])) + 1}
    assert tokens.read_store(spark, tokens.store(nothing, VOCABULARY)).collect() == []


def test_store_checks_the_dictionary(spark, rough):
    folder = tokens.store(rough, VOCABULARY)
    other = spark.read.parquet(f"{folder}/dictionary").selectExpr("X'00' AS dictionary", "dictionary_sha256", "width", "end_id").collect()
    spark.createDataFrame(other, "dictionary binary, dictionary_sha256 string, width int, end_id int").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(ValueError):
        tokens.read_store(spark, folder)


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(1, 4) == [(0, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80))
def test_bins_hold_everything_once(lengths):
    bins = packing.match_bins(Counter(lengths), 60)
    assert all(n > 0 and sum(b) <= 60 and sum(3 * x > 60 for x in b) <= 2 for n, b in bins)
    assert Counter(x for n, b in bins for _ in range(n) for x in b) == Counter(lengths)


def test_bins_are_nearly_as_few_as_can_be():
    draw = random.Random(3)
    lengths = [min(2048, int(draw.lognormvariate(6, 1.1)) + 1) for _ in range(20_000)]
    n = sum(n for n, _ in packing.match_bins(Counter(lengths), 2048))
    assert n <= 1.01 * sum(lengths) / 2048 + 1
    assert packing.match_bins({}, 2048) == []


def check_packing(packed, texts, plain, capacity=2048):
    inside, of_doc = defaultdict(list), defaultdict(list)
    for r in packed:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
        of_doc[r["doc_id"]].append(r)
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for i, some in texts.items():
        expected = []
        for text in some:
            ids = plain(text) + [0]
            expected += [(p, s, n, crc(ids[s: s + n])) for p, (s, n) in enumerate(packing.cuts(len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in of_doc[i]) == sorted(expected)
    return len(inside)


def test_packing_against_plain_encoding(spark, plain):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    packed = QUERIES["op9_best_fit_packing"](spark, FOLDER).collect()
    n = check_packing(packed, texts, plain)
    assert n <= 1.02 * sum(r["length"] for r in packed) / 2048 + 1


def test_packing_of_rough_rows(spark, rough, nothing, plain):
    texts = defaultdict(list)
    for r in rough.collect():
        texts[r["doc_id"]].append(r["text"])
    packed = packing.pack(rough, VOCABULARY, capacity=64, keep_ids=True)
    check_packing(packed.collect(), texts, plain, 64)
    full = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 256 for r in full)
    assert packing.pack(nothing, VOCABULARY).collect() == []


def test_a_word_is_merged_once_at_text_and_line_starts(plain):
    class Counted:
        def __init__(self, model):
            self.model, self.pieces = model, Counter()

        def tokenize(self, piece):
            self.pieces[piece] += 1
            return self.model.tokenize(piece)

    encoder = Encoder(VOCABULARY)
    encoder._model = counted = Counted(encoder._model)
    text = "Grüße word\nGrüße, word!\nword\nGrüße"
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder([text])] == [plain(text)]
    assert counted.pieces == Counter(["GrÃ¼ÃŁe", "Ġword", "word", ",", "!"])


def test_different_pieces_of_a_batch_are_looked_up_once(plain):
    class Counted(dict):
        looked_up = 0

        def get(self, *key):
            self.looked_up += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.looked_up += 1
            return super().__getitem__(key)

    encoder = Encoder(VOCABULARY)
    encoder._young = counted = Counted(encoder._young)
    texts = ["word, word word. " * 200 + "\nword", "", None, "word word"] * 50
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(texts)] == [plain(t) for t in texts]
    assert counted.looked_up < 50


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé×÷Çȿɀª \n\t1'.-sd\x1c\x85\xa0\u2009\u2028\u3000\u180e—’я日\u0301😀\0\x7f"), max_size=30), max_size=5))
def test_pieces_equal_whole_texts(plain, words, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in words(texts)] == [plain(t) for t in texts]


def test_each_character_between_others(plain):
    encoder = Encoder(VOCABULARY)
    for c in [*map(chr, range(0x300)), *map(chr, range(0x1670, 0x1690)), *map(chr, range(0x1FF0, 0x2070)), "\u180e", "\u3000", "\ufeff", "\ufffd"]:
        texts = [a + c + b for a in ("", "a", "1", ",", "'", " ", "\n", "é", c) for b in ("", "a", "1", ",", "'s", " a", "\na", "é", "\u3000")]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder(texts)] == [plain(t) for t in texts], hex(ord(c))
