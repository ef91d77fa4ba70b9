"""Hard negatives by maximum inner product search: length buckets and coordinate pruning in the manner of LEMP.

Vectors are dealt by length, longest first, and each task cuts its share into buckets, in which every coordinate of the
normalised vectors is kept as a sorted list. Anchors are the stated queries and meet the buckets in blocks of bounded size. For
an anchor q and a bucket with longest vector l only vectors with an inner product of t or more count, t being the worst of the
best found so far. So their angle to q is at most arccos(t / |q| l): a bucket is passed over if there is no such angle, and for the largest
coordinates of q (the focus) the angle leaves a range of values, which is looked up in the sorted lists. Vectors that lie in all
ranges are verified exactly.

The first search finds the positives of every anchor, the second one, for each positive, the best vectors of other labels inside
its band of scores. Components are integers, so scores are exact: in floating point while they stay below 2^53, and in Python's
integers beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslattice.llm.common import stage_path, staged

BUCKET = 1024  # vectors in a bucket
BLOCK = 4096  # anchors that are searched for at a time
FOCUS = 3  # coordinates whose ranges are intersected
SLACK = 1e-9  # relative, on the side of keeping a vector
PART_ROWS = 50_000  # vectors per task
_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


class Vectors(NamedTuple):
    """Rows of vectors with whole numbers as components."""
    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    values: np.ndarray
    length: np.ndarray


def _vectors(frame: pd.DataFrame, size: int) -> Vectors:
    values = np.frombuffer(b"".join(frame["values"]), dtype=np.float64).reshape(len(frame), size)
    return Vectors(frame["row"].to_numpy(np.int64), frame["id"].to_numpy(np.int64), frame["label"].to_numpy(np.int64), values,
                   np.sqrt((values * values).sum(axis=1)))


def _products(a: Vectors, b: Vectors) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    if a.values.shape[1] == 0:
        return np.zeros((len(a.id), len(b.id)))
    most = np.abs(a.values).max(initial=0) * np.abs(b.values).max(initial=0) * a.values.shape[1]
    if most < _EXACT:
        return a.values @ b.values.T
    whole = np.vectorize(int, otypes=[object])
    return np.dot(whole(a.values), whole(b.values).T)


def _part(v: Vectors, at: np.ndarray) -> Vectors:
    return Vectors(*(column[at] for column in v))


class Bucket:
    """Vectors of similar length with a sorted list per coordinate of the normalised vectors."""

    def __init__(self, vectors: Vectors):
        self.vectors = vectors
        self.longest = float(vectors.length.max())
        directions = vectors.values / np.where(vectors.length > 0, vectors.length, 1)[:, None]
        order = np.argsort(directions, axis=0, kind="stable")
        self.lists = np.take_along_axis(directions, order, axis=0)
        self.ranks = np.empty_like(order)
        np.put_along_axis(self.ranks, order, np.arange(len(order))[:, None], axis=0)

    def candidates(self, anchors: Vectors, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors that need this bucket, and for each of them which vectors can have a product of `least` or more."""
        reach = anchors.length * self.longest * (1 + SLACK)
        asking = np.flatnonzero(~(least > reach))
        mask = np.ones((len(asking), len(self.ranks)), dtype=bool)
        bounded = np.flatnonzero(least[asking] > 0)  # without a positive bound every direction is possible
        if not len(bounded):
            return asking, mask
        who = asking[bounded]
        widest = np.arccos(np.clip(least[who] / reach[who], 0, 1)) + SLACK
        directions = anchors.values[who] / anchors.length[who, None]
        focus = np.argsort(-np.abs(directions), axis=1, kind="stable")[:, :FOCUS]
        for coordinate in np.unique(focus):
            mine = np.flatnonzero((focus == coordinate).any(axis=1))
            angle = np.arccos(np.clip(directions[mine, coordinate], -1, 1))
            low = np.cos(np.minimum(np.pi, angle + widest[mine])) - SLACK
            high = np.cos(np.maximum(0, angle - widest[mine])) + SLACK
            start = np.searchsorted(self.lists[:, coordinate], low, side="left")
            end = np.searchsorted(self.lists[:, coordinate], high, side="right")
            narrow = end - start < len(self.ranks)
            if narrow.any():
                rank = self.ranks[:, coordinate]
                mask[bounded[mine[narrow]]] &= (rank >= start[narrow, None]) & (rank < end[narrow, None])
        return asking, mask


def _verified(anchors: Vectors, bucket: Bucket, asking: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Exact products where the mask is set, minus infinity elsewhere."""
    some = np.flatnonzero(mask.any(axis=0))
    scores = np.full(mask.shape, -np.inf)
    if len(some):
        products = _products(_part(anchors, asking), _part(bucket.vectors, some))
        if products.dtype == object:
            scores = scores.astype(object)
        scores[:, some] = np.where(mask[:, some], products, -np.inf)
    return scores


class Best:
    """The best `few` vectors of each of n searches so far, by score and then by the smaller id."""

    def __init__(self, n: int, few: int):
        self.few = few
        self.search, self.id, self.score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.least = np.full(n, -np.inf)  # score that a further vector needs

    def add(self, searches: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: one row per search, minus infinity where there is nothing to add."""
        floor = self.least[searches]
        if scores.dtype != object and scores.shape[1] > self.few:
            floor = np.maximum(floor, -np.partition(-scores, self.few - 1, axis=1)[:, self.few - 1])
        a, b = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if not len(a):
            return
        found = scores[a, b]
        search, id_ = np.r_[self.search, searches[a]], np.r_[self.id, ids[b]]
        score = np.concatenate([self.score.astype(found.dtype), found])
        order = sorted(range(len(score)), key=lambda i: (search[i], -score[i], id_[i])) if score.dtype == object else np.lexsort((id_, -score, search))
        search, id_, score = search[order], id_[order], score[order]
        starts = np.flatnonzero(np.r_[True, search[1:] != search[:-1]])
        place = np.arange(len(search)) - np.repeat(starts, np.diff(np.r_[starts, len(search)]))
        keep = place < self.few
        last = keep & (place == self.few - 1)
        self.search, self.id, self.score = search[keep], id_[keep], score[keep]
        self.least[search[last]] = score[last].astype(float) if score.dtype != object else [_below(s) for s in score[last]]


def _below(score: int) -> float:
    """A float that is not above the integer."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


def prepared(vectors: DataFrame, classes: int, moved: int) -> DataFrame:
    """(row, id, label, values, length): rows that take part, components as floor(256 x), row by row numbered."""
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("x")).filter(
        "id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND abs(256 * c) < double('Infinity'))")
    size = usable.agg(F.max(F.size("x"))).first()[0] or 0
    label = F.when(F.col("id") % moved == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [np.floor(256 * np.asarray(x, dtype=np.float64)) for x in frame["x"]]
            whole = [np.r_[v, np.zeros(size - len(v))] for v in values]
            yield pd.DataFrame({"row": frame["row"], "id": frame["id"], "label": frame["label"],
                                "values": [v.tobytes() for v in whole], "length": [float(np.sqrt((v * v).sum())) for v in whole]})

    numbered = usable.select("id", label.alias("label"), "x", F.monotonically_increasing_id().alias("row"))
    return numbered.mapInPandas(scaled, "row long, id long, label long, values binary, length double")


def _searched(index: DataFrame, anchors: Vectors, size: int, band: tuple[np.ndarray, np.ndarray] | None, few: int,
              rows: int) -> DataFrame:
    """(search, id, score): the best `few` of each task; without bands the same label, with bands (lowest and highest score
    of each search, anchor by anchor) another label."""
    shared = index.sparkSession.sparkContext.broadcast((tuple(anchors), band))
    per = 1 if band is None else len(band[0]) // len(anchors.id)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, band = shared.value
        anchors = Vectors(*columns)
        best = Best(len(anchors.id) * per, few)
        for frame in frames:
            for at in range(0, len(frame), rows):
                bucket = Bucket(_vectors(frame.iloc[at: at + rows], size))
                if band is None:
                    _same_label(anchors, bucket, best)
                else:
                    _other_label(anchors, bucket, best, band[0].reshape(-1, per), band[1].reshape(-1, per))
        yield pd.DataFrame({"search": best.search, "id": best.id, "score": [min(max(int(s), _LONG[0]), _LONG[1]) for s in best.score]})

    return index.select("row", "id", "label", "values").mapInPandas(search, "search long, id long, score long")


def _same_label(anchors: Vectors, bucket: Bucket, best: Best) -> None:
    asking, mask = bucket.candidates(anchors, best.least)
    mask &= anchors.id[asking, None] != bucket.vectors.id[None, :]
    for label in np.intersect1d(anchors.label[asking], bucket.vectors.label):
        a, b = np.flatnonzero(anchors.label[asking] == label), np.flatnonzero(bucket.vectors.label == label)
        some = mask[np.ix_(a, b)]
        if some.any():
            best.add(asking[a], bucket.vectors.id[b], _verified_part(anchors, bucket, asking[a], b, some))


def _verified_part(anchors: Vectors, bucket: Bucket, asking: np.ndarray, columns: np.ndarray, mask: np.ndarray) -> np.ndarray:
    products = _products(_part(anchors, asking), _part(bucket.vectors, columns))
    return np.where(mask, products, -np.inf)


def _other_label(anchors: Vectors, bucket: Bucket, best: Best, lowest: np.ndarray, highest: np.ndarray) -> None:
    per = lowest.shape[1]
    bounds = lowest if lowest.dtype != object else np.array([_below(s) for s in lowest.ravel()]).reshape(lowest.shape)
    needed = np.maximum(best.least.reshape(-1, per), bounds)
    needed[(lowest > highest).astype(bool)] = np.inf  # an empty band asks for nothing
    asking, mask = bucket.candidates(anchors, needed.min(axis=1))
    mask &= (anchors.label[asking, None] != bucket.vectors.label[None, :]) & (anchors.id[asking, None] != bucket.vectors.id[None, :])
    if not mask.any():
        return
    scores = _verified(anchors, bucket, asking, mask)
    for k in range(per):
        inside = ((scores >= lowest[asking, k, None]) & (scores <= highest[asking, k, None])).astype(bool)
        best.add(asking * per + k, bucket.vectors.id, np.where(inside, scores, -np.inf))


def _ranked(found: DataFrame, few: int) -> DataFrame:
    """The best `few` of each search over all tasks, which gave `few` each."""
    order = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= few)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, classes: int = 10, moved: int = 7,
                   lowest: int = 50, highest: int = 95, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by `every`; where it is divisible by `moved`, the label is (label + 1) %
    classes. Each anchor's first `positives` rows of its label are its positives, and the first `negatives` rows of other labels with
    a score between `lowest` and `highest` percent of a positive's are that positive's negatives. Higher scores come first,
    then smaller ids.

    Rows with a null id, label, vector or component, or a component that is not finite (times 256) take no part. Shorter vectors
    count as zeros beyond their end. Rows that share the anchor's vec_id are no partners of it; otherwise repeated rows and ids are
    rows of their own, so equal lines can be returned. Scores beyond a long count as the nearest long. Tables without
    usable rows or anchors give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = staged(prepared(vectors, classes, moved), "negatives-rows")
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("values")).alias("bytes")).first()
    size = (shape["bytes"] or 0) // 8
    parts = max(-(-shape["n"] // PART_ROWS), spark.sparkContext.defaultParallelism)
    index = staged(rows.repartitionByRange(parts, F.desc("length"), "row").sortWithinPartitions(F.desc("length"), "row"), "negatives-index")
    # Row numbers grow without gaps inside a part of the table, so a block of numbers holds at most `block` rows.
    asked = staged(rows.filter(F.col("id") % every == 0).withColumn("row", F.monotonically_increasing_id()).withColumn(
        "block", F.floor(F.col("row") / block)), "negatives-anchors")
    out = stage_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for (number,) in asked.select("block").distinct().orderBy("block").collect():
        anchors = _vectors(asked.filter(F.col("block") == number).toPandas(), size)
        found = _ranked(_searched(index, anchors, size, None, positives, bucket), positives).toPandas()
        found = found.sort_values(["search", "rank"], ignore_index=True)
        table = np.full((len(anchors.id), positives, 2), 0, dtype=np.int64)
        at = (found["search"].to_numpy(np.int64), found["rank"].to_numpy(np.int64) - 1)
        table[at] = found[["id", "score"]].to_numpy(np.int64)
        asked_for = np.zeros(table.shape[:2], dtype=bool)
        asked_for[at] = True
        # Whole-number bounds: 100 * negative >= lowest * positive, 100 * negative <= highest * positive.
        exact = float if np.abs(table[:, :, 1]).max(initial=0) < _EXACT / max(lowest, highest, 100) else object
        low, high = np.full(table.shape[:2], 1, dtype=exact), np.full(table.shape[:2], 0, dtype=exact)
        low[at] = [-(-lowest * s // 100) for s in found["score"].tolist()]
        high[at] = [highest * s // 100 for s in found["score"].tolist()]
        negative = _ranked(_searched(index, anchors, size, (low.ravel(), high.ravel()), negatives, bucket), negatives)
        ids, positive_ids, scores = np.repeat(anchors.id, positives), table[:, :, 0].ravel(), table[:, :, 1].ravel()
        asks = np.flatnonzero(asked_for.ravel())
        pairs = spark.createDataFrame(pd.DataFrame({
            "search": asks, "anchor_id": ids[asks], "positive_id": positive_ids[asks], "positive_score": scores[asks]}),
            "search long, anchor_id long, positive_id long, positive_score long")
        negative.join(pairs, "search").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
    return spark.read.schema(RESULT).parquet(out)
