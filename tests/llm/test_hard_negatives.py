import math

import numpy as np
import pytest

from opslattice.llm import hard_negatives as H
from opslattice.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, row string, search string, length string"


def brute_force(rows):
    """rows: (vec_id, vector, label); Python integers throughout."""
    usable = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        usable.append((i, [math.floor(256 * c) for c in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, x, label in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, y, other in usable if j != i)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [(n, j) for n, j, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(i, positive, rank, j, -p, -n) for rank, (n, j) in enumerate(inside[:3], 1)]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(i, x, label, "r", "s", "l") for i, x, label in rows], SCHEMA).repartition(4)


def vectors(seed, n=400, size=6, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, size))
    x = centres[rng.integers(0, 8, n)] + rng.normal(size=(n, size)) * 0.4
    x *= np.exp(rng.normal(size=n) * spread)[:, None]
    return [(i, x[i].tolist(), int(rng.integers(0, 10))) for i in range(n)]


@pytest.mark.parametrize("seed, spread", [(1, 0.0), (2, 1.5)])
def test_against_all_products(spark, seed, spread):
    rows = vectors(seed, spread=spread)
    assert found(H.hard_negatives(table(spark, rows), block=3, bucket=32)) == brute_force(rows)


def test_query(spark):
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert found(QUERIES["op13_hard_negatives"](spark, FOLDER)) == brute_force(rows)


def test_ties_copies_zeros_and_lengths(spark):
    rows = [(i, [1.0, 0.5], i % 3) for i in range(120)] + [(i, [0.0, 0.0], 1) for i in range(200, 210)]
    rows += [(i, [1.0], 2) for i in range(300, 310)] + [(i, [], 2) for i in range(400, 403)] + [(i, [-1.0, -0.5], 0) for i in range(500, 520)]
    rows += [rows[50], rows[50], rows[51], (100, [0.7, 0.7], 4)]
    assert found(H.hard_negatives(table(spark, rows))) == brute_force(rows)


def test_nulls_and_unusable_components(spark):
    rows = vectors(3, n=120, size=3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (1000, None, 1), (1050, [1.0, None, 1.0], 1), (1100, [float("nan"), 1.0, 1.0], 2),
             (1150, [float("inf"), 1.0, 1.0], 2), (1200, [1.0, 1.0, 1.0], None)]
    assert found(H.hard_negatives(table(spark, rows))) == brute_force(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(-40, 60, 3) * 1e5 + rng.integers(0, 9, 3) / 256).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    assert found(H.hard_negatives(table(spark, rows))) == brute_force(rows)


def test_empty(spark):
    assert found(H.hard_negatives(table(spark, []))) == []
    assert found(H.hard_negatives(table(spark, [(1, [1.0], 1), (2, [1.0], 1)]))) == []
    assert found(H.hard_negatives(table(spark, [(50, [1.0], 1)]))) == []


def test_candidates_keep_all_that_reach_the_bound():
    rng = np.random.default_rng(4)
    values = np.floor(256 * rng.normal(size=(300, 5)) * np.exp(rng.normal(size=300))[:, None])
    rows = np.arange(300)
    bucket = H.Bucket(H.Vectors(rows, rows, rows, values, np.linalg.norm(values, axis=1)))
    asked = np.floor(256 * rng.normal(size=(40, 5)))
    asked[:10, 1:] //= 20  # most of the length in one coordinate
    anchors = H.Vectors(np.arange(40), np.arange(40), np.arange(40), asked, np.linalg.norm(asked, axis=1))
    products = asked @ values.T
    least = np.sort(products, axis=1)[:, -5]
    asking, mask = bucket.candidates(anchors, least)
    assert set(asking) == set(range(40))
    assert mask[products >= least[:, None]].all()
    assert mask[:10].mean() < 0.5  # and drop much of the rest where a coordinate says much
    nobody, _ = bucket.candidates(anchors, np.full(40, 1e12))
    assert len(nobody) == 0
