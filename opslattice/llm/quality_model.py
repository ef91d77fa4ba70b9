"""Quality scores: histogram gradient-boosted trees over document statistics, walked as flat arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.llm.common import fold, hash_sample, id_and_text

TRAINING_DOCS = 20_000  # the trees are fitted on so many labelled documents, drawn by a hash of their ids
TREES, DEPTH, BINS, RATE = 60, 4, 64, 0.15
LEAST_WEIGHT, RIDGE = 5.0, 1.0
ACCEPT = 0.7

FEATURES = ["log_chars", "log_words", "chars_per_word", "digits", "capitals", "punctuation", "symbols", "bars", "quotes", "newlines",
            "blanks", "non_ascii", "distinct_words", "top_word", "repeated_lines", "short_lines", "lines", "sentence_ends",
            "words_with_symbols", "longest_word", "letter_entropy"]
_DIGITS, _CAPITALS, _SPACE = b"0123456789", bytes(range(65, 91)), b" \t\n\r\x0b\x0c"


def _members(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([_members(c) for c in (
    _DIGITS, _CAPITALS, b".,;:!?()-", b"#*$%&<>@^~=+", b"|", b"\"'`", b"\n", _SPACE, bytes(range(128, 256)), b".!?")])


def document_features(text: str | None) -> list[float]:
    """Values of FEATURES for one whole text; null is the empty text, and all shares of nothing are 0."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
    size = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(float)
    digits, capitals, points, symbols, bars, quotes, newlines, blanks, high, ends = (_CLASSES @ counts / size).tolist()
    shares = counts[counts > 0] / size
    words = raw.split()
    n = max(len(words), 1)
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = sum(c for w, c in distinct.items() if not w.rstrip(b".,;:!?)").isalnum() and w.isascii())
    return [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / n, digits, capitals, points, symbols, bars, quotes, newlines, blanks,
            high, len(distinct) / n, max(distinct.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1),
            sum(len(x) < 40 for x in lines) / max(len(lines), 1), math.log1p(len(lines)), ends * size / n, marked / n,
            math.log1p(max(map(len, distinct), default=0)), float(-(shares * np.log(shares)).sum())]


class Forest(NamedTuple):
    """Complete trees of equal depth as arrays (tree, node): a row goes to child 2i+1 if its value <= cut, else to 2i+2."""
    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2 ** DEPTH - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def _best_splits(bins: np.ndarray, node: np.ndarray, nodes: int, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) with the largest gain for each node; bin BINS sends all rows to the left."""
    best = np.zeros(nodes)
    feature, at = np.zeros(nodes, dtype=np.int64), np.full(nodes, BINS)
    for f in range(bins.shape[1]):
        cell = node * BINS + bins[:, f]
        g = np.bincount(cell, gradient, nodes * BINS).reshape(nodes, BINS)
        h = np.bincount(cell, hessian, nodes * BINS).reshape(nodes, BINS)
        gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
        gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
        gain = gl ** 2 / (hl + RIDGE) + gr ** 2 / (hr + RIDGE) - gl[:, -1:] ** 2 / (hl[:, -1:] + RIDGE)
        gain[(hl < LEAST_WEIGHT / 4) | (hr < LEAST_WEIGHT / 4)] = 0
        top = gain.argmax(axis=1)
        better = gain[np.arange(nodes), top] > best + 1e-9
        best = np.where(better, gain[np.arange(nodes), top], best)
        feature, at = np.where(better, f, feature), np.where(better, top, at)
    return feature, at


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost trees on the logistic loss; features are seen as at most BINS histogram bins."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = math.log(share / (1 - share))
    margin = np.full(len(y), start)
    inner = 2 ** DEPTH - 1
    all_features, all_cuts, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for depth in range(DEPTH):
            first, count = 2 ** depth - 1, 2 ** depth
            f, at = _best_splits(bins, node, count, gradient, hessian)
            feature[first: first + count] = f
            cut[first: first + count] = [edges[i][b] if b < len(edges[i]) else np.inf for i, b in zip(f, at)]
            node = 2 * node + (bins[np.arange(len(y)), f[node]] > at[node])
        g, h = np.bincount(node, gradient, inner + 1), np.bincount(node, hessian, inner + 1)
        leaf = RATE * g / (h + RIDGE)
        margin += leaf[node]
        all_features.append(feature)
        all_cuts.append(cut)
        leaves.append(leaf)
    return Forest(start, np.stack(all_features), np.stack(all_cuts), np.stack(leaves))


def fit(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> Forest:
    """Trees from labelled documents that are not held out; without any, every score is 0.5."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg(
        F.min("quality").cast("double").alias("label"))
    drawn = hash_sample(known, "doc_id", training_docs, "quality")

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "x": [document_features(t) for t in frame["text"]]})

    rows = id_and_text(docs).join(drawn, "doc_id").select("label", "text").mapInPandas(measure, "label double, x array<double>").toPandas()
    if not len(rows):
        inner = 2 ** DEPTH - 1
        return Forest(0.0, np.zeros((1, inner), dtype=np.int64), np.full((1, inner), np.inf), np.zeros((1, inner + 1)))
    x = np.array(rows["x"].tolist())
    order = np.lexsort((*x.T, rows["label"]))  # sums of floats depend on the order, the order of rows must not
    return grow(x[order], rows["label"].to_numpy()[order])


def scored(docs: DataFrame, labels: DataFrame, training_docs: int = TRAINING_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Only the text decides. Null texts count as empty and are scored too. A document labelled both ways is learned as bad;
    labels other than 0 and 1 are ignored. Repeated rows are scored row by row; rows without doc_id are never learned from
    and not held out. An empty table gives no rows; other columns are ignored.
    """
    forest = docs.sparkSession.sparkContext.broadcast(tuple(fit(docs, labels, training_docs)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(Forest(*forest.value).scores(np.array([document_features(t) for t in texts])))

    return id_and_text(docs).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), score("text").alias("score")) \
        .withColumn("predicted", F.when(F.col("score") >= ACCEPT, 1).otherwise(0))
