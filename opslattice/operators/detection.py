"""Anomaly detectors on count vectors, topology and event sequences."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Correlation
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslattice.functions.statistics import binomial_tail
from opslattice.operators.metrics import before_split, best_threshold, split_point, threshold_curve
from opslattice.plans.ranks import exact_percentile
from opslattice.plans.runtime import durable
from opslattice.plans.skew import history, numbered, salted_join, split_bursts

PERCENTILE = 0.96  # about one session in 25 is anomalous
SEED = 42


# ---------------------------------------------------------------- count vectors
def rule_detector(df: DataFrame, columns: list[str]) -> DataFrame:
    score = reduce(lambda a, b: a + b, [F.col(c) for c in columns], F.lit(0))
    return df.withColumn("score", score.cast("double")).withColumn("flag", F.col("score") > 0)


def fit_pca(train: DataFrame, columns: list[str], keep: float = 0.95) -> dict:
    """Mean, population std and eigenvectors of the correlation matrix.

    Spark accumulates the d x d matrix in parallel; only that matrix reaches the driver.
    Constant columns keep scale 1 and no correlation, so a value first seen after
    training still enters the residual.
    """
    d = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    mean = np.array([row[f"m{i}"] for i in range(d)])
    std = np.array([row[f"s{i}"] for i in range(d)])
    constant = std <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(constant, 1.0, std)
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(train).select("features")
    scaled = np.nan_to_num(Correlation.corr(vectors, "features").first()[0].toArray())
    scaled[constant, :] = scaled[:, constant] = 0.0
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    k = min(int(np.searchsorted(share, keep, side="right")) + 1, d)
    return {"columns": columns, "mean": mean.tolist(), "scale": scale.tolist(), "n_components": k,
            "components": vectors[:, :k].T.tolist(), "discarded": vectors[:, k:].T.tolist()}


def pca_residual(model: dict) -> Column:
    """Squared reconstruction error: the squared length along the discarded directions.

    Scaling is folded into the weights, so the residual is plain arithmetic on the columns.
    """
    total = F.lit(0.0)
    for direction in model["discarded"]:
        weights = [w / s for w, s in zip(direction, model["scale"])]
        offset = sum(w * m for w, m in zip(weights, model["mean"]))
        along = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(model["columns"], weights)]) - offset
        total = total + F.pow(along, F.lit(2.0))
    return total


def train_idf(train: DataFrame, columns: list[str]) -> list[float]:
    row = train.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c) > 0).alias(f"d{i}")
                                                   for i, c in enumerate(columns)]).first()
    return [float(np.log((1 + row["n"]) / (1 + row[f"d{i}"])) + 1) for i in range(len(columns))]


def assemble(df: DataFrame, features: list[Column]) -> DataFrame:
    names = [f"_x{i}" for i in range(len(features))]
    wide = df.select("*", *[f.cast("double").alias(n) for f, n in zip(features, names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide).drop(*names)


def balanced_logistic(train: DataFrame, label: str, max_iter: int = 100):
    """L2 logistic regression with C = 1 and class weights that sum to n."""
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(label).alias("p")).first()
    n, p = counts["n"], counts["p"]
    weight = F.when(F.col(label), n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1)))
    data = train.withColumn("label", F.col(label).cast("double")).withColumn("weight", weight)
    return LogisticRegression(weightCol="weight", standardization=False, regParam=1.0 / max(n, 1),
                              elasticNetParam=0.0, maxIter=max_iter).fit(data)


def positive_probability(scored: DataFrame) -> DataFrame:
    kept = [c for c in scored.columns if c not in ("features", "rawPrediction", "probability", "prediction")]
    return scored.select(*kept, vector_to_array("probability")[1].alias("score"))


def fit_logreg_counts(train: DataFrame, columns: list[str], label: str):
    """log1p counts weighted by train-only idf, balanced classes; returns (model, idf)."""
    idf = train_idf(train, columns)
    features = [F.log1p(F.col(c)) * w for c, w in zip(columns, idf)]
    return balanced_logistic(assemble(train, features), label), idf


def score_logreg_counts(df: DataFrame, columns: list[str], fitted) -> DataFrame:
    model, idf = fitted
    features = [F.log1p(F.col(c)) * w for c, w in zip(columns, idf)]
    scored = positive_probability(model.transform(assemble(df, features)))
    return scored.withColumn("flag", F.col("score") >= 0.5)


def top_feature_weights(columns: list[str], weights: list[float], k: int = 6) -> list[tuple[str, float]]:
    return sorted(zip(columns, (float(w) for w in weights)), key=lambda t: -abs(t[1]))[:k]


# ---------------------------------------------------------------- isolation forest
def _grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (left, right, feature, cut, size); leaves have left = -1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, -1, -1, 0.0, len(rows)])
        low, high = rows.min(axis=0), rows.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(varied):
            feature = int(rng.choice(varied))
            cut = float(rng.uniform(low[feature], high[feature]))
            mask = rows[:, feature] <= cut
            nodes[at][2:4] = [feature, cut]
            nodes[at][0] = grow(rows[mask], depth + 1)
            nodes[at][1] = grow(rows[~mask], depth + 1)
        return at

    grow(x, 0)
    return [tuple(n) for n in nodes]


def _unsuccessful_search(n):
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def fit_isolation_forest(train: DataFrame, columns: list[str], key: str, trees: int = 300, sample: int = 256,
                         seed: int = SEED) -> list[pd.DataFrame]:
    """Trees grow in parallel, one group of at most `sample` rows per tree."""
    # every (row, tree) draws a ticket of its own; twice as many as needed pass, and the lowest of each tree stay
    share = min(1.0, 2.0 * sample / max(train.count(), 1))

    def ticket(tree: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), tree, "_k"), F.lit(1 << 40))

    rows = train.select(F.col(key).alias("_k"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    # exploded first: a plain filter is compiled, a filter inside an array is not
    drawn = (
        rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .filter(ticket(F.col("tree")) < int(share * (1 << 40)))
        .withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(ticket(F.col("tree")), "_k")))
        .filter(F.col("r") <= sample)
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = np.array(pdf.sort_values("r")["x"].tolist())
        nodes = _grow_tree(rows, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["left", "right", "feature", "cut", "size"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    schema = "tree int, node int, left int, right int, feature int, cut double, size int"
    forest = drawn.select("tree", "r", "x").groupBy("tree").applyInPandas(build, schema).toPandas()
    return [g.sort_values("node").reset_index(drop=True) for _, g in forest.groupby("tree")]


def _walkable(tree: pd.DataFrame) -> tuple:
    """(levels, feature, cut, children, length): leaves lead to themselves, so every row takes the same number of steps.

    children holds the right and the left child of each node in turn, length the path length of a row that ends at the node.
    """
    left, right = tree["left"].to_numpy(), tree["right"].to_numpy()
    inner = left >= 0
    depth = np.zeros(len(tree), dtype=np.int64)
    for node in np.flatnonzero(inner):  # children come after their parent
        depth[[left[node], right[node]]] = depth[node] + 1
    own = np.arange(len(tree))
    children = np.stack([np.where(inner, right, own), np.where(inner, left, own)], axis=1).ravel()
    feature = np.where(inner, tree["feature"].to_numpy(), 0)
    return int(depth.max()), feature, tree["cut"].to_numpy(), children, depth + _unsuccessful_search(tree["size"].to_numpy())


def score_isolation_forest(df: DataFrame, columns: list[str], forest: list[pd.DataFrame]) -> DataFrame:
    """score = 2^(-mean depth / c)"""
    spark = df.sparkSession
    size = int(forest[0]["size"].iloc[0])
    shared = spark.sparkContext.broadcast([_walkable(g) for g in forest])  # at most trees * (2 * sample - 1) nodes
    norm = float(_unsuccessful_search(size)) or 1.0

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        x = np.array(xs.tolist(), dtype=float).reshape(len(xs), -1)
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        depth = np.zeros(len(x))
        for levels, feature, cut, children, length in shared.value:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(levels):
                below = flat.take(start + feature.take(node)) <= cut.take(node)
                node = children.take(2 * node + below)
            depth += length.take(node)
        return pd.Series(np.power(2.0, -depth / len(shared.value) / norm))

    return df.withColumn("score", score(F.array(*[F.col(c).cast("double") for c in columns])))


# ---------------------------------------------------------------- scorers as pipeline stages
class Scoring(NamedTuple):
    """How one method learns from training rows and adds a score column."""
    learn: Callable[[DataFrame, list[str], str], object]
    score: Callable[[DataFrame, list[str], object], DataFrame]
    fixed_threshold: float | None = None


SCORINGS = {
    "events": Scoring(lambda train, columns, key: None, lambda df, columns, state: rule_detector(df, columns).drop("flag"), 0.0),
    "residual": Scoring(lambda train, columns, key: fit_pca(train, columns), lambda df, columns, state: df.withColumn("score", pca_residual(state))),
    "isolation": Scoring(fit_isolation_forest, score_isolation_forest),
}


class _ScorerParams(Params):
    method = Param(Params._dummy(), "method", "one of " + ", ".join(SCORINGS), TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "numeric columns that are scored", TypeConverters.toListString)
    key = Param(Params._dummy(), "key", "column that identifies a row", TypeConverters.toString)
    percentile = Param(Params._dummy(), "percentile", "share of training scores at or below the threshold", TypeConverters.toFloat)

    def _scoring(self) -> Scoring:
        return SCORINGS[self.getOrDefault("method")]


class AnomalyScorer(Estimator, _ScorerParams, DefaultParamsWritable, DefaultParamsReadable):
    """Fits one of SCORINGS and a threshold: the method's own, or a percentile of the training scores.

    Estimator and model can be saved, alone or as stages of a pipeline.
    """

    def __init__(self, method: str | None = None, columns: list[str] | None = None, key: str = "block_id", percentile: float = PERCENTILE):
        super().__init__()
        self._set(**{k: v for k, v in {"method": method, "columns": columns, "key": key, "percentile": percentile}.items() if v is not None})

    def _fit(self, train: DataFrame) -> AnomalyScorerModel:
        how, columns = self._scoring(), self.getOrDefault("columns")
        state = how.learn(train, columns, self.getOrDefault("key"))
        threshold = how.fixed_threshold
        if threshold is None:
            threshold = exact_percentile(how.score(train, columns, state), "score", self.getOrDefault("percentile"))
        return self._copyValues(AnomalyScorerModel(state, threshold))


class _ScorerWriter(MLWriter):
    """Params as every pipeline stage stores them, and what was learned (scaler and components, or trees) as one JSON row."""

    def __init__(self, model: AnomalyScorerModel):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self._model, path, self.sparkSession)
        state = self._model._state
        if isinstance(state, list):
            state = {"trees": [{c: g[c].tolist() for c in g.columns} for g in state]}
        self.sparkSession.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.parquet(f"{path}/state")


class _ScorerReader(MLReader):
    def load(self, path: str) -> AnomalyScorerModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = json.loads(self.sparkSession.read.schema("state string").parquet(f"{path}/state").first()["state"])
        if isinstance(state, dict) and "trees" in state:
            state = [pd.DataFrame(tree) for tree in state["trees"]]
        model = AnomalyScorerModel(state)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class AnomalyScorerModel(Model, _ScorerParams, MLWritable, MLReadable):
    """Adds score and flag; rows above the threshold are flagged."""

    threshold = Param(Params._dummy(), "threshold", "scores above it are flagged", TypeConverters.toFloat)

    def __init__(self, state=None, threshold: float | None = None):
        super().__init__()
        self._state = state
        if threshold is not None:
            self._set(threshold=threshold)

    def write(self) -> MLWriter:
        return _ScorerWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ScorerReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self._scoring().score(df, self.getOrDefault("columns"), self._state)
        return scored.withColumn("flag", F.col("score") > self.getOrDefault("threshold"))


# ---------------------------------------------------------------- topology
def binomial_hotspots(touch: DataFrame, labels: DataFrame, host: str, key: str, alpha: float = 0.05,
                      min_support: int = 0) -> DataFrame:
    """Hosts whose share of anomalous keys is significantly above the overall rate.

    `touch` holds distinct (host, key), `labels` one (key, is_anomaly) row per key.
    """
    flagged = F.count_if("is_anomaly")
    per_host = durable(  # read for the number of tests, for the order and for the rows
        touch.join(labels.select(key, "is_anomaly").hint("shuffle_hash"), key)
        .groupBy(host).agg(F.count(F.lit(1)).alias("blocks"), flagged.alias("anomalous"))
    )
    base = labels.agg(F.avg(F.col("is_anomaly").cast("int")).alias("base"), F.lit(1).alias("_one"))
    tests = per_host.agg(F.count(F.lit(1)).alias("m"), F.lit(1).alias("_one"))
    scalars = base.join(tests, "_one")  # one row
    tested = per_host.withColumn("_one", F.lit(1)).join(F.broadcast(scalars), "_one").drop("_one")
    return (
        tested.filter(F.col("blocks") >= min_support)
        .withColumn("rate", F.col("anomalous") / F.col("blocks"))
        .withColumn("p_value", binomial_tail(F.col("anomalous"), F.col("blocks"), F.col("base")))
        .withColumn("significant", F.col("p_value") < F.lit(alpha) / F.col("m"))
        .select(host, "blocks", "anomalous", "rate", "p_value", "significant")
        .orderBy("p_value", host)
    )


def key_rate(placed: DataFrame, host: str, label: str, is_train: str | Column, min_support: int = 10) -> DataFrame:
    """Train-only rate per host; hosts below min_support train keys get the global rate later."""
    return placed.filter(is_train).groupBy(host).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label).alias("pos")
    ).withColumn("rate", F.when(F.col("n") >= min_support, F.col("pos") / F.col("n")))


def neighbour_risk(scores: DataFrame, placement: DataFrame, key: str, host: str, min_blocks: int = 10,
                   asked: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Add host_risk: the highest train-only rate among the hosts that store the key.

    Hosts without enough support and keys without placement count with the global
    train rate. `asked` holds the rows of scores to return and their placement, which may repeat;
    rates come from all train keys all the same.
    """
    glob = scores.filter(F.col("split") == "train").agg(
        F.avg(F.col("y").cast("int")).alias("_glob"), F.lit(1).alias("_one"))
    train = scores.filter(F.col("split") == "train").select(key, "y").hint("shuffle_hash")
    rates = key_rate(placement.select(key, host).join(train, key), host, "y", F.lit(True), min_blocks)
    rated, stored = (scores, placement) if asked is None else asked
    known = stored.select(key, host).join(rates.select(host, "rate"), host, "left")
    risk = known.groupBy(key).agg(F.max("rate").alias("_max"), F.count_if(F.col("rate").isNull()).alias("_unknown"))
    return (
        rated.join(risk, key, "left").withColumn("_one", F.lit(1)).join(F.broadcast(glob), "_one")
        .withColumn("host_risk", F.when(F.coalesce("_unknown", F.lit(1)) > 0,
                                        F.greatest("_max", "_glob")).otherwise(F.col("_max")))
        .drop("_max", "_unknown", "_glob", "_one")
    )


RISK_GRID = [round(0.05 * i, 2) for i in range(1, 19)]


def neighbour_risk_report(scored: DataFrame, threshold: float) -> DataFrame:
    """Effect of adding `host_risk >= threshold` to the base flag, on the test split."""
    y, base, risky = F.col("y"), F.col("flag"), F.col("host_risk") >= threshold
    return scored.filter(F.col("split") == "test").agg(
        F.count_if(y & (base | risky)).alias("tp"), F.count_if(base | risky).alias("flagged"),
        F.count_if(y).alias("positives"),
        F.count_if(y & ~base & risky).alias("rescued"), F.count_if(~y & ~base & risky).alias("false_added"),
    ).withColumn("threshold", F.lit(threshold))


def choose_risk_threshold(scored: DataFrame) -> float:
    train = scored.filter(F.col("split") == "train")
    curve = threshold_curve(train, F.col("y"), F.col("host_risk"), RISK_GRID, base=F.col("flag"))
    return best_threshold(curve).first()["threshold"]


# ---------------------------------------------------------------- event sequences
def sequence_fingerprint(events: DataFrame, key: str, bucket: str, order: list[str], template: str) -> DataFrame:
    """A 128-bit fingerprint of the ordered template list of every key.

    Positions are assigned bucket by bucket and hashed with the template, so no list
    is ever collected.
    """
    placed = numbered(split_bursts(events, [key], bucket, order), [key], bucket, order)
    part = F.xxhash64(F.col("pos"), F.col(template)).cast("decimal(20,0)")
    other = F.xxhash64(F.lit(1), F.col(template), F.col("pos")).cast("decimal(20,0)")
    return placed.groupBy(key).agg(F.count(F.lit(1)).alias("len"), F.sum(part).alias("h1"), F.sum(other).alias("h2"))


def sequence_identity(fingerprints: DataFrame, missed: DataFrame, normal_train: DataFrame, key: str) -> DataFrame:
    """Missed keys whose event list equals the list of some normal training key."""
    known = fingerprints.join(normal_train.select(key), key, "left_semi").select("len", "h1", "h2").distinct()
    return fingerprints.join(missed.select(key), key, "left_semi").join(known, ["len", "h1", "h2"], "left_semi").select(key)


UNSEEN_RANK = 1_000_000


def context_model(train: DataFrame, hist: str, event: str, lengths: list[int]) -> DataFrame:
    """Next-event counts per context (the last L events), with rank and probability.

    rank = number of candidates with a strictly higher count. The table has at most
    V^(L+1) rows for V templates, whatever the number of events.
    """
    counts = (
        with_contexts(train, hist, lengths).groupBy("ctx", F.col(event).alias("next"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    whole = Window.partitionBy("ctx")
    return (
        counts.withColumn("total", F.sum("cnt").over(whole)).withColumn("candidates", F.count(F.lit(1)).over(whole))
        .withColumn("rank", F.rank().over(whole.orderBy(F.desc("cnt"))) - 1)
        .withColumn("p", F.col("cnt") / F.col("total"))
    )


def with_contexts(df: DataFrame, hist: str, lengths: list[int]) -> DataFrame:
    """One row per usable context length; a context is 'L|event,event'."""
    def text(length: int) -> Column:
        if length == 0:
            return F.lit("0|")
        tail = F.slice(F.col(hist), F.greatest(F.size(hist) - length + 1, F.lit(1)), F.lit(length))
        return F.when(F.size(hist) >= length, F.concat(F.lit(f"{length}|"), F.concat_ws(",", tail)))

    contexts = F.array(*[F.struct(F.lit(n).alias("len"), text(n).alias("ctx")) for n in lengths])
    return (
        df.withColumn("_c", F.explode(F.filter(contexts, lambda c: c["ctx"].isNotNull())))
        .select(*df.columns, F.col("_c.len").alias("ctx_len"), F.col("_c.ctx").alias("ctx"))
    )


def next_event_scores(train_seq: DataFrame, seq: DataFrame, key: str, event_key: str, event: str,
                      lengths: tuple[int, ...] = tuple(range(10, -1, -1)), max_rank: int = UNSEEN_RANK,
                      hot_rows: int = 1_000_000) -> DataFrame:
    """Per key the worst rank and lowest probability of its true next events.

    An event is judged by the longest context seen in training. Within that context an
    event that never followed ranks after all candidates with p = 0; an event outside the
    training vocabulary gets UNSEEN_RANK. Both inputs carry a `history` array.
    """
    lengths = list(lengths)
    model = durable(context_model(train_seq, "history", event, lengths))  # read three times below
    seen_contexts = model.select("ctx", "candidates").distinct()
    vocabulary = model.filter(F.col("ctx") == "0|").select(F.col("next").alias(event), F.lit(True).alias("_known"))
    # each event needs its contexts only once per distinct (contexts, event): reduce before joining
    shapes = seq.withColumn("_recent", F.slice(F.col("history"),
                            F.greatest(F.size("history") - max(lengths) + 1, F.lit(1)), F.lit(max(lengths))))
    distinct = shapes.groupBy("_recent", event).agg(F.count(F.lit(1)).alias("_n"))
    expanded = with_contexts(distinct.withColumn("_shape", F.concat_ws(",", "_recent")), "_recent", lengths)
    found = expanded.join(seen_contexts, "ctx")
    longest = found.groupBy("_shape", event).agg(
        F.max(F.struct("ctx_len", "ctx", "candidates")).alias("b")
    ).select("_shape", event, F.col("b.ctx").alias("ctx"), F.col("b.candidates").alias("candidates"))
    judged = (
        longest.join(model.select("ctx", F.col("next").alias(event), "rank", "p"), ["ctx", event], "left")
        .join(vocabulary, event, "left")
        .select(
            "_shape", event,
            F.when(F.col("_known").isNull(), F.lit(max_rank)).otherwise(F.coalesce("rank", "candidates")).alias("rank"),
            F.when(F.col("_known").isNull(), F.lit(0.0)).otherwise(F.coalesce("p", F.lit(0.0))).alias("p"),
        )
    )
    scored = salted_join(
        shapes.select(key, event_key, event, F.concat_ws(",", "_recent").alias("_shape")),
        judged, ["_shape", event], event_key, "left", hot_rows,
    )
    return scored.groupBy(key).agg(
        F.max(F.coalesce("rank", F.lit(max_rank))).alias("max_rank"),
        F.min(F.coalesce("p", F.lit(0.0))).alias("min_p"),
    )


def padded_history(events: DataFrame, key: str, bucket: str, order: list[str], event: str, n: int = 10) -> DataFrame:
    """Previous n events, left-padded with '0'."""
    listed = history(split_bursts(events, [key], bucket, order), [key], bucket, order, event, n)
    pad = F.array_repeat(F.lit("0"), F.lit(n) - F.size("history"))
    return listed.withColumn("history", F.concat(pad, F.col("history")))


# ---------------------------------------------------------------- flow triage
# Remote-access and database ports.
SENSITIVE_PORTS = [22, 23, 445, 1433, 3389, 2375, 5900]
FLOW_FEATURES = [
    "dest_port", "src_port", "sensitive_port", "tcp", "pkts_toserver", "pkts_toclient", "bytes_toserver",
    "bytes_toclient", "duration_s", "no_reply", "state_new", "state_established", "state_closed",
    "app_failed", "app_http", "app_dns",
]


def flow_features(flows: DataFrame, *keep: str) -> DataFrame:
    """16 numeric columns; no address takes part."""
    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return flows.select(
        *keep, "dest_port", "src_port",
        flag(F.col("dest_port").isin(SENSITIVE_PORTS)).alias("sensitive_port"),
        flag(F.col("proto") == "TCP").alias("tcp"),
        "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient",
        seconds.alias("duration_s"), flag(F.col("pkts_toclient") == 0).alias("no_reply"),
        *[flag(F.col("state") == s).alias(f"state_{s}") for s in ("new", "established", "closed")],
        *[flag(F.col("app_proto") == a).alias(f"app_{a}") for a in ("failed", "http", "dns")],
    )


TRIAGE_GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def rule_triage(features: DataFrame) -> DataFrame:
    score = F.col("sensitive_port") + 1e-9 * F.col("pkts_toserver")
    return features.withColumn("score", score).withColumn("flag", F.col("sensitive_port") == 1)


def logistic_triage(train: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    features = [F.log1p(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))) for c in FLOW_FEATURES]
    model = balanced_logistic(assemble(train, features), label)
    scored = positive_probability(model.transform(assemble(rows, features)))
    return scored.withColumn("flag", F.col("score") >= 0.5)


BOOST_ROWS = 50_000  # rows that are worth a task of their own in a round of boosting
BOOST_MOST = 2_000_000  # rows of one task at most


def boosting_parts(rows: int, cores: int) -> int:
    """Parts of the training rows: one per BOOST_ROWS up to the number of cores, and as many more as keep a part at BOOST_MOST."""
    return max(min(-(-rows // BOOST_ROWS), cores), -(-rows // BOOST_MOST), 1)


def boosted_triage(features: DataFrame, ts: str, key: str, label: str, rounds: int = 300) -> DataFrame:
    """Boosted trees on the first 70 %; operating threshold from the last 20 % of train.

    A round is a chain of short jobs, each over all training rows. The rows are dealt over the cores once, and the two fits, which do not
    need each other, run side by side.
    """
    train_end = split_point(features, ts, key, lambda n: int(n * 0.7))
    fit_end = split_point(features, ts, key, lambda n: int(int(n * 0.7) * 0.8))
    is_train = before_split(F.col(ts), F.col(key), train_end)
    is_fit = before_split(F.col(ts), F.col(key), fit_end)
    columns = [c for c in FLOW_FEATURES]
    numeric = features.select(ts, key, label, *[F.col(c).cast("double").alias(c) for c in columns])
    filled = Imputer(inputCols=columns, outputCols=columns).fit(numeric.filter(is_train)).transform(numeric)
    data = assemble(filled, [F.col(c) for c in columns]).withColumn("label", F.col(label).cast("double"))
    spark = features.sparkSession
    parts = boosting_parts(features.count(), spark.sparkContext.defaultParallelism)
    spread = data if parts == 1 else durable(data.repartition(parts, ts, key))

    booster = GBTClassifier(maxIter=rounds, stepSize=0.05, seed=SEED, maxDepth=5)
    with ThreadPool(2) as pool:
        fitted, final = pool.map(inheritable_thread_target(spark)(lambda train: booster.copy().fit(train)),
                                 [spread.filter(is_fit), spread.filter(is_train)], 1)
    validation = positive_probability(fitted.transform(data.filter(is_train & ~is_fit)))
    curve = threshold_curve(validation, F.col(label), F.col("score"), TRIAGE_GRID)
    threshold = best_threshold(curve).first()["threshold"]
    test = positive_probability(final.transform(data.filter(~is_train)))
    return test.withColumn("flag", F.col("score") >= threshold).withColumn("threshold", F.lit(threshold))


def miss_analysis(test: DataFrame, alerts: DataFrame, key: str = "flow_id") -> DataFrame:
    """Missed alerted rows per alert category, most frequent first."""
    category = alerts.groupBy(key).agg(F.min("category").alias("category"))
    missed = test.filter(F.col("alerted") & ~F.col("flag"))
    named = missed.join(category, key, "left")
    return (
        named.groupBy(F.coalesce("category", F.lit("no linked alert record")).alias("category"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
    )


def recall_by_reputation(test: DataFrame, alerts: DataFrame, is_reputation: Column, key: str = "flow_id") -> DataFrame:
    """Recall on alerted rows with and without any reputation signature."""
    reputed = alerts.filter(is_reputation).select(key).distinct().withColumn("_rep", F.lit(True))
    alerted = test.filter("alerted").join(reputed, key, "left")
    rep = F.col("_rep").isNotNull()
    return alerted.agg(
        F.avg(rep.cast("int")).alias("reputation_share"),
        F.avg(F.when(rep, F.col("flag").cast("int"))).alias("recall_reputation"),
        F.avg(F.when(~rep, F.col("flag").cast("int"))).alias("recall_behavioural"),
    )


def next_event_detector(listed: DataFrame, parts: DataFrame, key: str, event_key: str, event: str,
                        lengths: tuple[int, ...] = tuple(range(10, -1, -1)), max_g: int = 12) -> DataFrame:
    """Train on normal 'fit' keys, choose g by F1 on 'validation', flag 'test' keys with rank >= g.

    `listed` carries a `history` column, `parts` one (key, part, y) row per key.
    """
    normal = parts.filter((F.col("part") == "fit") & ~F.col("y")).select(key)
    train = listed.join(normal, key, "left_semi")
    scores = next_event_scores(train, listed, key, event_key, event, lengths).join(parts.select(key, "part", "y"), key)
    vocabulary = train.select(event).distinct().count()
    grid = [float(g) for g in range(1, max(2, min(vocabulary + 1, max_g)))]
    curve = threshold_curve(scores.filter(F.col("part") == "validation"), F.col("y"), F.col("max_rank"), grid)
    g = best_threshold(curve).first()["threshold"]
    clipped = F.greatest(F.least(F.col("min_p"), F.lit(1.0)), F.lit(1e-12))
    return scores.filter(F.col("part") == "test").select(
        key, "y", "max_rank", (F.col("max_rank") >= g).alias("flag"), (-F.log(clipped)).alias("score"),
        F.lit(int(g)).alias("g"))
