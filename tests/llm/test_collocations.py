import random
import re
from collections import Counter, defaultdict

import pytest

from opslattice.llm import collocations as C
from opslattice.llm.queries import QUERIES
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.001"


def brute_force(rows, least=30, top=2000, percent=80):
    """rows: (lang, text); everything counted phrase by phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        chosen = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        inside = Counter()
        for p, n in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i: i + k]] = max(inside[p[i: i + k]], n)
        ranked = []
        for p, a in chosen.items():
            if 100 * inside[p] >= percent * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def invented(seed, n=150, words=25, langs=("en", "de", None)):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcß.,A") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return [(rng.choice(langs), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", "\n", ", "]) for _ in range(rng.randint(0, 120))))
            for _ in range(n)]


def frame(spark, rows):
    return documents(spark, [t for _, t in rows], [lang for lang, _ in rows]).repartition(5)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_counting_phrase_by_phrase(spark, seed):
    rows = invented(seed)
    assert found(C.collocations(frame(spark, rows))) == brute_force(rows)


def test_copies_and_one_word(spark):
    rows = [("en", "to be or not to be, that is the question")] * 40 + [("en", "na " * 500)] + [(None, "be or not")] * 31
    assert found(C.collocations(frame(spark, rows))) == brute_force(rows)


def test_limits(spark):
    rows = invented(7, n=80)
    assert found(C.collocations(frame(spark, rows), least=5, top=7, percent=50)) == brute_force(rows, 5, 7, 50)


@pytest.mark.parametrize("period, most", [(1, 512), (2, 5), (1000, 4), (7, 1)])
def test_chunks_hold_every_phrase_once(period, most):
    rng = random.Random(period)
    for _ in range(200):
        tokens = [rng.choice([b"a", b"b", b"c", b"\n"]) for _ in range(rng.randint(0, 40))]
        seen, back = Counter(), []
        for chunk, last in C.parse(tokens, period, most):
            part = chunk.split(b" ")
            own = len(part) if last else len(part) - C.OVERLAP
            assert own > 0
            back += part[:own]
            for k in range(1, C.LONGEST + 1):
                seen.update(tuple(part[i: i + k]) for i in range(own) if i + k <= len(part))
        assert back == tokens
        assert seen == Counter(tuple(tokens[i: i + k]) for k in range(1, C.LONGEST + 1) for i in range(len(tokens) - k + 1))


def test_equal_passages_share_chunks(spark):
    rng = random.Random(5)
    passage = " ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(400))
    rows = [("en", f"{i} {passage} {i}") for i in range(50)]
    parsed = C.dictionary(frame(spark, rows))
    total, distinct = parsed.selectExpr("sum(n)", "count(1)").first()
    assert distinct < total / 5


def test_false_hits_change_nothing(spark):
    rows = invented(3, n=60)
    assert found(C.collocations(frame(spark, rows), least=10, table_bits=256)) == brute_force(rows, 10)


def test_query(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert found(QUERIES["op12_collocations"](spark, FOLDER)) == brute_force(rows)


def test_rough_rows(spark, rough, nothing):
    rows = [(r["lang"], r["text"]) for r in rough.collect()]
    assert found(C.collocations(rough, least=2)) == brute_force(rows, 2)
    assert found(C.collocations(nothing)) == []
