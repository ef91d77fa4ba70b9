"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslattice.llm import (
    collocations, decontam, hard_negatives, langid, licenses, neardup, packing, pii, quality_model, rules, token_counts, tokens, warc)
from opslattice.llm.common import stage_path

QUERIES, ORACLES = {}, {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from the token store."""
    folder = tokens.store(table(spark, sf_dir, "documents"), VOCABULARY, end_id=2)
    return tokens.read_store(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document."""
    return packing.pack(table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048, end_id=0)


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document among near duplicates."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=75)


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents"))


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.predicted(table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document."""
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query
def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the pages in WARC files, against a second copy whose storage has lost bits under unchanged headers."""
    pages = warc.segments(table(spark, sf_dir, "pages"))
    good, aged = stage_path(spark, "warc"), stage_path(spark, "warc")
    warc.write_warc(pages, good)
    warc.write_warc(warc.decayed(pages), aged)
    return warc.audit(warc.read_records(spark, good), warc.read_records(spark, aged))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY, limit=2048)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000, percent=80)


ORACLES["op12_collocations"] = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts),
rows AS (SELECT lang, [x for x in regexp_split_to_array(p, '[\\x20\\x09]+') if x <> ''] AS w FROM pieces),
grams AS (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
    FROM rows, (SELECT unnest([1, 2, 3, 4]) AS k)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM cand),
scores AS (
    SELECT c.*, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
    FROM cuts c
    JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
    SELECT c.lang, c.a, unnest(flatten([[array_to_string(c.w[i:i + k - 1], ' ') for i in range(1, c.size - k + 2)] for k in range(2, c.size)])) AS phrase
    FROM cand c WHERE c.size > 2),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL),
kept AS (
    SELECT s.* FROM lowest s LEFT JOIN longer o USING (lang, phrase)
    WHERE o.most IS NULL OR 100 * o.most::HUGEINT < 80 * s.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of every anchor."""
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = """
WITH base AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) for x in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS anchor_id, p.vec_id AS id, q.label = p.label AS same, list_dot_product(q.v, p.v)::BIGINT AS score
    FROM base q JOIN base p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
found AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, n.id AS negative_id, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id) AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    WHERE 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
