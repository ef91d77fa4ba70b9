"""Language of a text, word first: known words by their frequency per language, unseen words by ever shorter n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import fold, hash_sample, id_and_text, staged

TRAINING_DOCS = 4000  # the model is fitted on so many labelled documents, drawn by a hash of their ids
KNOWN_WORDS, KNOWN_GRAMS = 60_000, 30_000  # size of the model: the most frequent words, and n-grams of each length
LONGEST = 5
SMOOTHING = 0.5
EVIDENCE = 40  # words after which more text does not sharpen the score
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i: i + n] for i in range(len(padded) - n + 1)]


class Model(NamedTuple):
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]  # by length, from 1 on


def _log_frequencies(counted: list[tuple[str, list[int]]], totals: np.ndarray) -> dict[str, np.ndarray]:
    sizes = np.log(totals + SMOOTHING * (len(counted) + 1))
    return {token: np.log(np.array(n) + SMOOTHING) - sizes for token, n in counted}


def fit(docs: DataFrame, training_docs: int = TRAINING_DOCS) -> Model:
    """Frequencies per language from documents that are not held out; without any, the model knows no language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    drawn = hash_sample(known.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), "doc_id", training_docs, "langid")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = Counter()
            for lang, text in zip(frame["lang"], frame["text"]):
                seen.update((lang, w) for w in words_of(text))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in seen.items()], columns=["lang", "word", "n"])

    counts = staged(drawn.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
                    .groupBy("lang", "word").agg(F.sum("n").alias("n")), "langid-words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([], {}, [{} for _ in range(LONGEST)])
    per_language = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]

    def frequent(table: DataFrame, limit: int) -> dict[str, np.ndarray]:
        totals = table.agg(*per_language).first()
        # The model's size is a parameter; what it leaves out is scored by shorter units.
        top = table.groupBy("token").agg(F.sum("n").alias("_n"), *per_language).filter("_n > 1").orderBy(F.desc("_n"), "token").limit(limit)
        return _log_frequencies([(r["token"], list(r)[2:]) for r in top.collect()], np.array(list(totals), dtype=float))

    def all_grams(n: int) -> DataFrame:
        padded = F.concat(F.lit("^"), "word", F.lit("$"))
        at = F.sequence(F.lit(1), F.length(padded) - n + 1)
        pieces = F.when(F.length(padded) >= n, F.transform(at, lambda i: F.substring(padded, i, n)))
        return counts.select("lang", "n", F.explode(pieces).alias("token"))

    by_gram = [frequent(all_grams(n), KNOWN_GRAMS) for n in range(1, LONGEST + 1)]
    return Model(languages, frequent(counts.select("lang", "n", F.col("word").alias("token")), KNOWN_WORDS), by_gram)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.unseen = model, {}
        self.nothing = np.zeros(len(model.languages))

    def word(self, word: str) -> np.ndarray:
        """Log frequency per language: of the word, or the mean over its longest n-grams that are known."""
        found = self.model.words.get(word)
        if found is None:
            found = self.unseen.get(word)
        if found is None:
            found = self.nothing
            for n in range(LONGEST, 0, -1):
                known = self.model.grams[n - 1]
                hits = [known[g] for g in grams(word, n) if g in known]
                if hits:
                    found = sum(hits) / len(hits)
                    break
            if len(self.unseen) > 100_000:
                self.unseen.clear()
            self.unseen[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        seen = Counter(words_of(text))
        if not self.model.languages or not any(c.isalpha() for w in seen for c in w):
            return UNKNOWN, 0.0
        total = sum(seen.values())
        score = np.array(list(seen.values()), dtype=float) @ np.array([self.word(w) for w in seen])
        score = score / total * min(total, EVIDENCE)
        best = int(score.argmax())
        return self.model.languages[best], float(1 / np.exp(score - score[best]).sum())


def predicted(docs: DataFrame, training_docs: int = TRAINING_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of docs.

    Only the text decides. Null texts and texts without a letter are "und" with score 0, and so is everything if there is no
    labelled document to learn from. A tie goes to the language that sorts first. Repeated rows are scored row by row; rows
    without doc_id are never learned from and not held out. An empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, training_docs))

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        one = Scorer(model.value)
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return id_and_text(docs).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
                                    score("text").alias("_p")).select("doc_id", "held_out", "_p.*")
