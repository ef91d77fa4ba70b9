import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from opslattice.llm import langid, quality_model, rules
from opslattice.llm.queries import QUERIES
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_statistics(text):
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeated)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_base_statistics_of_tricky_texts():
    texts = [None, "", " \t\r\n\x0b\x0c ", "a\xa0b c d", "x x x x x", "a b c a b c", "a b c d a b c", "a\na\n\n\n a\na\r\na", "##|<>$%&* é😀",
             "a b " * 40, "one\ntwo\none\n\none ", "\x1c\x1d a"]
    for t in texts:
        assert rules.text_statistics(t)[:5] == base_statistics(t), repr(t)


def test_quality_rules_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op7_quality_rules"](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        n, chars, symbols, lines, repeats = base_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_exact_binomial_bound():
    for n, k, p in [(10, 0, 0.1), (50, 3, 0.05), (200, 20, 0.07), (5, 5, 0.5)]:
        exact = sum(np.prod([(n - j) / (j + 1) for j in range(i)]) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.at_most(k, n, p) == pytest.approx(exact, rel=1e-9)
    n = rules.needed(0.01, 0.003)
    assert rules.at_most(0, n, 0.01) <= 0.003 < rules.at_most(0, n - 1, 0.01)


def test_certified_cutoffs_part_bad_from_good():
    good, bad = [0] * 201, [0] * 201
    good[0], good[10], bad[60], bad[5] = 970, 30, 80, 20
    assert 10 <= rules.certified(good, bad, 0.03, 0.01) < 60
    assert rules.certified([20, *[0] * 200], bad, 0.03, 0.01) is None  # too few good documents to certify anything
    good[100] = 200
    assert rules.certified(good, bad, 0.03, 0.01) >= 99  # stricter cutoffs would reject too many good ones


def test_false_rejections_stay_below_the_risk():
    draw = np.random.default_rng(2)
    wrong = 0
    for _ in range(200):
        values = draw.beta(1, 12, 3000)
        good = np.bincount(np.ceil(values * 200).astype(int), minlength=201).tolist()
        bad = np.bincount(np.ceil(draw.beta(2, 6, 500) * 200).astype(int), minlength=201).tolist()
        cut = rules.certified(good, bad, 0.02, 0.05)
        true_share = (1 - cut / 200) ** 12 if cut is not None else 0  # of Beta(1, 12)
        wrong += true_share > 0.02
    assert wrong <= 20


@pytest.fixture(scope="module")
def labelled(spark):
    """Clean and junk documents in two languages, one of which has too few labels of its own."""
    clean = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(900)]
    junk = [" ".join(f"w{i}y{j}###" for j in range(60)) for i in range(100)]
    texts = clean + junk
    langs = ["en" if i % 10 else "xx" for i in range(len(texts))]
    docs = documents(spark, texts, langs)
    labels = spark.createDataFrame([(i, int(i < 900), 0) for i in range(1000) if i % 2 or i % 4] + [(1, None, 0), (3, 7, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_rules_reject_junk_and_keep_clean_documents(spark, labelled):
    docs, labels = labelled
    rows = {r["doc_id"]: r["kept"] for r in rules.judged(docs, labels, risk=0.06).collect()}
    # too few labels in "xx": nothing is certified there, and its junk stays
    kept = [i for i in range(1000) if i < 900 or i % 10 == 0]
    assert sorted(i for i in rows if rows[i]) == kept
    left = rules.accepted(docs, labels, risk=0.06)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == kept


def test_without_labels_only_the_base_rule_rejects(spark, rough, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = rules.judged(rough, labels).collect()
    assert len(rows) == rough.count() and all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert rules.accepted(rough, labels).columns == rough.columns
    assert rules.judged(nothing, labels).collect() == [] and rules.accepted(nothing, labels).collect() == []


def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, FOLDER).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.98 * len(out)


def test_language_back_off():
    words = {"the": np.log([0.9, 0.1])}
    by_gram = [{}, {}, {"chu": np.log([0.1, 0.9])}, {}, {}]
    score = langid.Scorer(langid.Model(["en", "xx"], words, by_gram))
    assert score("the the")[0] == "en" and score("achung")[0] == "xx"
    assert score("qqq") == ("en", 0.5)  # nothing known: a tie goes to the first
    assert score(None) == score("12 34 !") == score("") == ("und", 0.0)
    assert langid.grams("ab", 3) == ["^ab", "ab$"] and langid.grams("ab", 5) == []


def test_language_of_rough_rows(spark, rough, nothing):
    rows = langid.predicted(rough).collect()
    assert len(rows) == rough.count()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 4, 8) or False) for r in rows if r["doc_id"] is not None)
    assert langid.predicted(nothing).collect() == []
    unlabelled = documents(spark, ["some text", None])
    assert {r["lang_pred"] for r in langid.predicted(unlabelled).collect()} == {"und"}


def test_language_never_uses_held_out_rows_or_the_column(spark):
    texts = ["alpha beta gamma"] * 40 + ["delta epsilon zeta"] * 40
    langs = ["aa" if (i < 40) != held_out(i) else "bb" for i in range(80)]  # held-out rows are labelled the wrong way round
    rows = langid.predicted(documents(spark, texts, langs)).collect()
    assert all(r["lang_pred"] == ("aa" if r["doc_id"] < 40 else "bb") for r in rows)


def test_quality_of_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op6_quality_classifier"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held_out(r["doc_id"]) for r in rows)
    out = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in out) >= 0.95 * len(out)


def test_trees_learn_an_interaction_and_arrays_match_a_walk():
    draw = np.random.default_rng(0)
    x = draw.random((3000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    forest = quality_model.grow(x, y)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = forest.start
        for t in range(len(forest.feature)):
            node = 0
            for _ in range(quality_model.DEPTH):
                node = 2 * node + (1 if row[forest.feature[t, node]] <= forest.cut[t, node] else 2)
            total += forest.leaf[t, node - (2 ** quality_model.DEPTH - 1)]
        return total

    assert np.allclose(forest.margins(x[:50]), [walk(r) for r in x[:50]])


def test_quality_of_rough_rows(spark, rough, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (9, 0, 0), (2, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_model.scored(rough, labels).collect()
    assert len(rows) == rough.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality_model.scored(rough, labels.limit(0)).collect()} == {0.5}
    assert quality_model.scored(nothing, labels).collect() == []


def test_features_of_nothing():
    for text in (None, "", " ", "\n\n"):
        values = quality_model.document_features(text)
        assert len(values) == len(quality_model.FEATURES) and np.isfinite(values).all()
    assert list(itertools.chain(quality_model.FEATURES))[0] == "log_chars"
