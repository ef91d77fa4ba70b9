import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from opslattice.llm import neardup
from opslattice.llm.queries import QUERIES
from tests.llm.conftest import documents


def brute_force(texts):
    """{id: (shingles, smallest id reachable)} by comparing all pairs that share a shingle."""
    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[k:] for k in range(5))))
    parent, holders = {i: i for i in sets}, defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    result = QUERIES["op10_minhash_near_dedup"](spark, folder)
    assert found(result) == brute_force(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in result.collect())


@pytest.fixture(scope="module")
def crowded():
    """Chains of edits, a hub whose copies differ from each other, passages shared by otherwise different texts."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(120):  # star: every copy is near the base, many are not near each other
        copy = list(base)
        for at in draw.sample(range(120), 3):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    chain = [word() for _ in range(100)]
    for _ in range(40):
        chain = list(chain)
        chain[draw.randrange(100)] = word()
        texts.append(" ".join(chain))
    for _ in range(80):
        texts.append(" ".join(passage + [word() for _ in range(draw.randrange(5, 60))]))
    texts += [" ".join(base)] * 20 + ["", None, "one two", "ONE  two", "one two three"]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_crowded_buckets_lose_no_link(spark, crowded, block):
    assert found(neardup.near_duplicates(documents(spark, crowded), block=block)) == brute_force(dict(enumerate(crowded)))


def test_rough_rows(spark, rough, nothing):
    result = neardup.near_duplicates(rough)
    by_id = found(result.filter("doc_id IS NOT NULL"))
    assert set(by_id) == set(range(12)) and by_id[0][1] == by_id[1][1] == by_id[10][1] == 0
    assert by_id[2] == (0, 2) and by_id[3] == (0, 3) and by_id[6] == (1, 6)
    unnamed = result.filter("doc_id IS NULL").collect()
    assert len(unnamed) == 2 and all(r["kept"] and r["component_id"] is None for r in unnamed)
    left = neardup.without_duplicates(rough)
    assert left.columns == rough.columns
    assert sorted(r["doc_id"] for r in left.filter("doc_id IS NOT NULL").collect()) == [0, 2, 3, 4, 5, 6, 7, 8, 9, 11]
    assert left.filter("doc_id IS NULL").count() == 2
    assert neardup.near_duplicates(nothing).collect() == [] and neardup.without_duplicates(nothing).collect() == []


def test_odd_sketches_tell_high_similarities():
    draw = np.random.default_rng(5)
    for share in (0.95, 0.85, 0.75, 0.5):
        common = draw.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        sides = [np.concatenate([common, draw.integers(0, 1 << 63, (4000 - len(common)) // 2, dtype=np.uint64)]) for _ in range(2)]
        a, b = (np.frombuffer(neardup.odd_sketch(neardup.minhash(s)), np.uint8) for s in sides)
        differing = int(np.bitwise_count(a ^ b).sum())
        estimate = 1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * differing / neardup.BITS)
        assert abs(estimate - share) < 0.12


def test_texts_outside_all_buckets_are_not_carried_on(spark, monkeypatch):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(30)]
    texts += [texts[3] + " more", texts[4] + " more", texts[4]]
    carried, staged = {}, neardup.staged

    def noted(df, label, *more):
        out = staged(df, label, *more)
        if "body" in out.columns:
            carried[label] = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        return out

    monkeypatch.setattr(neardup, "staged", noted)
    assert found(neardup.near_duplicates(documents(spark, texts))) == brute_force(dict(enumerate(texts)))
    del carried["neardup-signatures"]
    assert carried == {"neardup-cards": [3, 4, 30, 31]}
