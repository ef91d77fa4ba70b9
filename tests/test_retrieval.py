"""BM25 by block maxima against scoring every document."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opslattice.operators import retrieval as X


def same(column):
    return column


def brute_force(docs, queries, k):
    counts = {d: Counter(t) for d, t in docs.items()}
    n, average = len(docs), sum(len(t) for t in docs.values()) / len(docs)
    df = Counter(w for c in counts.values() for w in c)
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: r if r >= 0 else 0.25 * mean for w, r in raw.items()}
    out = {}
    for q, words in queries.items():
        scores = {}
        for d, c in counts.items():
            if any(w in c for w in words):
                scores[d] = sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(docs[d]) / average)) for w in words if w in c)
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
        out[q] = [(d, pytest.approx(scores[d])) for d in best]
    return {q: rows for q, rows in out.items() if rows}


@pytest.mark.parametrize("seed, block_docs, hot", [(1, 4, 1_000_000), (2, 1, 20), (3, 1000, 1_000_000)])
def test_block_maxima_lose_no_document(spark, seed, block_docs, hot):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(300)]
    docs = {i: [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] for i in range(150)} | {500: [], 501: ["w1", "w1"], 502: ["w1", "w1"]}
    queries = {q: [rng.choice([*vocabulary, "unseen"]) for _ in range(rng.randint(1, 6))] for q in range(40)} | {99: ["unseen"], 98: []}
    d = spark.createDataFrame(list(docs.items()), "id int, tokens array<string>")
    terms = X.query_terms(spark.createDataFrame(list(queries.items()), "q int, tokens array<string>"), "q", F.col("tokens"), same)
    index = X.bm25_index(d, "id", F.col("tokens"), same)
    got = {}
    for r in X.bm25_topk_indexed(index, terms, 5, hot, block_docs).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["doc"], r["score"]))
    assert got == brute_force(docs, queries, 5)


def test_blocks_below_the_floor_are_not_scored(spark, monkeypatch):
    rng = random.Random(5)
    docs = {i: ["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(0, 20) + (["rare"] * 3 if i < 3 else []) for i in range(400)}
    d = spark.createDataFrame(list(docs.items()), "id int, tokens array<string>")
    terms = X.query_terms(spark.createDataFrame([(1, ["rare", "common"])], "q int, tokens array<string>"), "q", F.col("tokens"), same)
    sizes, scored = [], X._scored
    monkeypatch.setattr(X, "_scored", lambda *args: sizes.append(scored(*args).count()) or scored(*args))
    best = X.bm25_topk_indexed(X.bm25_index(d, "id", F.col("tokens"), same), terms, 2, block_docs=4)
    assert [(r["doc"]) for r in best.orderBy("rank").collect()] == [d for d, _ in brute_force(docs, {1: ["rare", "common"]}, 2)[1]]
    assert sum(sizes) < 100  # of 400 documents that share a term


def test_report_rates_hosts_and_splits_blocks_once(spark, monkeypatch):
    from opslattice.catalog import QUERIES, joins, reports

    calls = {"binomial_hotspots": 0, "chrono_split": 0}
    for module, name in ((reports.D, "binomial_hotspots"), (joins, "chrono_split")):
        def counted(*args, _name=name, _whole=getattr(module, name), **more):
            calls[_name] += 1
            return _whole(*args, **more)

        monkeypatch.setattr(module, name, counted)
    QUERIES["x7_grounded_report"](spark, "/root/testdata/sf0.001")
    assert calls == {"binomial_hotspots": 1, "chrono_split": 1}
