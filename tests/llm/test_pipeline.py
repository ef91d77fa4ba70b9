import random
from collections import defaultdict

import pytest

import corpus_pipeline
from opslattice.llm import decontam, packing, rules
from opslattice.llm.queries import QUERIES
from tests.llm.conftest import documents
from tests.llm.test_neardup import brute_force

FOLDER = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_each_stage_on_its_own_input_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    # So few labels certify no cutoff: the base rule alone rejects.
    good = {}
    for i, t in texts.items():
        n, *_, repeats = rules.text_statistics(t)[:5]
        if n >= 50 and 100 * repeats <= 50 * n:
            good[i] = t
    assert kept["quality rules"] == good
    groups = brute_force(good)
    assert kept["MinHash near-dedup"] == {i: t for i, t in good.items() if groups[i][1] == i}
    items = [decontam.normalised(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i: t for i, t in kept["MinHash near-dedup"].items() if not any(x in decontam.normalised(t) for x in items)}
    assert kept["benchmark decontamination"] == clean
    assert set(kept["PII"]) == set(clean)
    assert not any("@example.com" in t or "555-" in t for t in kept["PII"].values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in last} == set(clean)
    whole = QUERIES | {"pipeline": corpus_pipeline.run}
    again = whole["pipeline"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in last)
    size = defaultdict(int)
    for r in again:
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= 2048


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_with_rough_and_empty_rows(spark, rough, nothing, stage, tmp_path):
    name, run = stage
    out = run(spark, rough, FOLDER)
    if name != "best-fit packing":
        assert out.columns == rough.columns
    # all rough texts are short or repeat themselves, so the quality rules leave none
    assert (out.count() > 0) == (name != "quality rules") and run(spark, nothing, FOLDER).count() == 0


def test_clean_documents_pass(spark):
    draw = random.Random(8)
    texts = [" ".join("".join(draw.choice("abcdefghijklm") for _ in range(6)) for _ in range(80)) for _ in range(60)]
    docs = documents(spark, texts, ["en"] * 60)
    for _, run in corpus_pipeline.STAGES[:-1]:
        out = run(spark, docs, FOLDER)
        assert {r["doc_id"]: r["text"] for r in out.collect()} == dict(enumerate(texts))
    assert packing.pack(docs, corpus_pipeline.VOCABULARY).count() == 60
