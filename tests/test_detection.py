"""Detectors, metrics and parsers on small fixtures."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from opslattice.catalog import QUERIES
from opslattice.functions import parsing as P
from opslattice.functions.statistics import binomial_tail
from opslattice.operators import detection as D
from opslattice.operators import metrics as M
from opslattice.plans.runtime import durable


def test_binomial_tail(spark):
    cases = [(55, 62, 313 / 7940), (16, 131, 313 / 7940), (0, 10, 0.3), (400, 1000, 0.4), (30, 1000, 0.4), (10, 10, 0.5)]
    df = spark.createDataFrame(cases, "a int, n int, p double")
    got = [r[0] for r in df.select(binomial_tail(F.col("a"), F.col("n"), F.col("p"))).collect()]
    for value, (a, n, p) in zip(got, cases):
        exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(a, n + 1))
        assert value == pytest.approx(exact, rel=1e-9)
    assert f"{got[0]:.3g}" == "2.17e-69" and f"{got[1]:.3g}" == "6.33e-05"


def test_pca_residual_matches_numpy(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 3))
    x = np.column_stack([base, base @ rng.normal(size=(3, 4)) + 0.05 * rng.normal(size=(200, 4)), np.zeros(200)])
    columns = [f"c{i}" for i in range(x.shape[1])]
    train = spark.createDataFrame(x.tolist(), columns)
    model = D.fit_pca(train, columns)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    order = np.argsort(values)[::-1]
    share = np.cumsum(values[order]) / values.sum()
    k = int(np.searchsorted(share, 0.95, side="right")) + 1
    kept = vectors[:, order[:k]]
    assert model["n_components"] == k
    expected = ((z - z @ kept @ kept.T) ** 2).sum(axis=1)
    got = [r[0] for r in train.select(D.pca_residual(model)).collect()]
    assert np.allclose(sorted(got), sorted(expected))
    w = np.array(model["components"] + model["discarded"])
    assert np.allclose(w @ w.T, np.eye(len(w)))
    # a column that is constant in training must raise the residual when it moves later
    moved = spark.createDataFrame([x[0].tolist()[:-1] + [7.0]], columns).select(D.pca_residual(model)).first()[0]
    assert moved > got[0] + 40


def test_isolation_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(300)] + [(999, 9.0, -9.0, 9.0)]
    df = spark.createDataFrame(rows, "block_id int, a double, b double, c double")
    forest = D.fit_isolation_forest(df, ["a", "b", "c"], "block_id", trees=30)
    assert len(forest) == 30 and all(g["size"].iloc[0] == 256 for g in forest)
    scored = D.score_isolation_forest(df, ["a", "b", "c"], forest)
    assert scored.orderBy(F.desc("score")).first()["block_id"] == 999
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 < low < high < 1


def test_scorers_as_pipeline_stages(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(100)], "block_id int, a double, b double")
    scorer = D.AnomalyScorer("residual", ["a", "b"])
    model = scorer.fit(df)
    rows = model.transform(df)
    assert rows.filter("flag").count() == rows.filter(F.col("score") > model.getOrDefault("threshold")).count()
    lower = scorer.copy({scorer.percentile: 0.5}).fit(df)
    assert lower.getOrDefault("threshold") <= model.getOrDefault("threshold") and lower.getOrDefault("percentile") == 0.5
    assert D.AnomalyScorer("events", ["a"]).fit(df).transform(df).filter("flag").count() == 80
    assert Pipeline(stages=[scorer]).fit(df).transform(df).count() == 100


@pytest.mark.parametrize("method", ["events", "residual", "isolation"])
def test_saved_scorers_score_as_before(spark, tmp_path, method):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, float(rng.randint(0, 5)), float(rng.randint(0, 3)), 1.0) for i in range(150)],
                               "block_id int, a double, b double, c double")
    scorer = D.AnomalyScorer(method, ["a", "b", "c"], percentile=0.9)
    scorer.write().save(str(tmp_path / "estimator"))
    assert D.AnomalyScorer.load(str(tmp_path / "estimator")).getOrDefault("percentile") == 0.9
    fitted = Pipeline(stages=[scorer]).fit(df)
    fitted.write().save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    columns = ["block_id", "score", "flag"]
    assert sorted(loaded.transform(df).select(columns).collect()) == sorted(fitted.transform(df).select(columns).collect())
    assert loaded.stages[0].getOrDefault("threshold") == fitted.stages[0].getOrDefault("threshold")
    assert loaded.stages[0].uid == fitted.stages[0].uid


def test_chrono_split_breaks_ties_by_id(spark):
    rng = random.Random(4)
    rows = [(i, f"2024-01-0{rng.randint(1, 3)} 00:00:00") for i in range(50)]
    df = spark.createDataFrame(rows, "id int, d string").withColumn("ts", F.to_timestamp("d"))
    train = {r["id"] for r in M.chrono_split(df, "ts", "id").filter("split = 'train'").collect()}
    assert train == {i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))[:35]}


def test_metrics_and_average_precision(spark):
    df = spark.createDataFrame([(True, 0.9, True), (False, 0.8, True), (True, 0.7, False), (False, 0.1, False)], "y boolean, s double, f boolean")
    row = M.binary_metrics(df, "y", "s", "f").first()
    assert row["pr_auc"] == pytest.approx(0.8333, abs=1e-4)
    assert row["roc_auc"] == pytest.approx(0.75)
    assert (row["precision"], row["recall"], row["flagged"]) == (0.5, 0.5, 2)
    two = M.binary_metrics(df.withColumn("s", F.round("s")), "y", "s", "f").first()
    assert two["roc_auc"] is None
    none = M.binary_metrics(df.withColumn("f", F.lit(False)), "y", "s", "f").first()
    assert (none["precision"], none["f1"]) == (0.0, 0.0)


def test_equal_f1_takes_the_lower_threshold(spark):
    df = spark.createDataFrame([(True, 0.6), (False, 0.1)], "y boolean, s double")
    best = M.best_threshold(M.threshold_curve(df, F.col("y"), F.col("s"), [0.2, 0.4, 0.6, 0.8])).first()
    assert best["threshold"] == 0.2 and best["f1"] == 1.0


def test_threshold_bounds_are_kept(spark):
    df = spark.createDataFrame([(True, 0.4)], "y boolean, s double")
    curve = M.threshold_curve(df, F.col("y"), F.col("s"), [0.4]).first()
    assert curve["tp"] == 1  # inclusive


def test_latency_p95_uses_the_floor_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 115)] + [(0.0,), (None,)], "ms double")
    row = M.latency_percentiles(df, "ms").first()
    assert (row["n"], row["p50"], row["p95"]) == (114, 57.5, 108.0)


def test_parsers_yield_null_on_a_miss(spark):
    df = spark.createDataFrame([("no key here", "bad-node"), ("Receiving block blk_-7 src: /1.2.3.4:5 dest: /1.2.3.4:6", "R01-M0-NA:J1")], "c string, n string")
    rows = df.select(P.extract_key(F.col("c")).alias("k"), *P.parse_hierarchy(F.col("n"))).collect()
    assert rows[0]["k"] is None and rows[0]["rack"] is None
    assert tuple(rows[1]) == ("blk_-7", "R01", "M0", "NA")
    moves = P.extract_transfers(df, "c", "n").collect()
    assert [tuple(r) for r in moves] == [("1.2.3.4", "1.2.3.4", "R01-M0-NA:J1")]
    assert df.select(P.compose_ts(F.lit("081109"), F.lit("3518"))).first()[0].isoformat() == "2008-11-09T00:35:18"


def test_external_addresses(spark):
    cases = {
        "8.8.8.8": True, "10.1.2.3": False, "172.16.0.1": False, "172.31.255.255": False, "172.32.0.1": True,
        "100.63.0.1": True, "100.64.0.1": False, "100.127.9.9": False, "100.128.0.1": True, "192.168.1.1": False,
        "2001:db8::1": True, "unknown": False, "300.1.1.1": False, "1.2.3": False, "1.2.3.4.5": False, "01.2.3.4": False, "1.2.3.4.": False,
    }
    df = spark.createDataFrame(list(cases.items()), "ip string, e boolean")
    wrong = df.filter(P.is_external_cidr(F.col("ip")) != F.col("e")).collect()
    assert wrong == []
    assert df.filter(P.is_external_cidr(F.lit(None).cast("string"))).count() == 0


def test_flow_records(spark):
    def line(src="8.8.8.8", dst="10.0.0.1", dport="80", proto="6", action="REJECT"):
        return f"1 61 eni-1 {src} {dst} 443 {dport} {proto} 3 180 {action} 2"

    lines = [line(), "short", line(src="-"), line(proto="1", dport="-"), line(proto="47", dport="32768", action="ACCEPT"),
             line(dport="32767", action="ACCEPT"), line(src="100.64.0.9"), line(dst="garbage"), line(src="2001:db8::9")]
    out = P.parse_flow_record(spark.createDataFrame([(m,) for m in lines], "m string"), "m")
    assert out.count() == 7
    assert {r["proto"] for r in out.collect()} == {"tcp", "icmp", "47"}
    kept = P.inbound_unsolicited(out).collect()
    assert sorted(r["dport"] for r in kept) == [80, 80, 80, 32767]


def test_next_event_unseen_template(spark):
    def rows(key, text):
        return [(f"{key}{i}", key, e, list(text[max(0, i - 3):i])) for i, e in enumerate(text)]

    schema = "line string, session string, template string, history array<string>"
    train = spark.createDataFrame(rows("a", "xyxyxy") + rows("b", "xyxz"), schema)
    test = spark.createDataFrame(rows("c", "xy") + rows("d", "xq") + rows("e", "zz"), schema)
    got = {r["session"]: (r["max_rank"], r["min_p"]) for r in D.next_event_scores(train, test, "session", "line", "template").collect()}
    assert got["c"][0] == 0
    assert got["d"] == (D.UNSEEN_RANK, 0.0)
    assert got["e"][0] == 2  # after nothing known, z is the least frequent template
    salted = D.next_event_scores(train, test, "session", "line", "template", hot_rows=1)
    assert {r["session"]: (r["max_rank"], r["min_p"]) for r in salted.collect()} == got


def test_stemming(spark):
    words = {"deleted": "delet", "deleting": "delet", "boxes": "box", "blocks": "block", "cats": "cats", "aaa5s": "aaa5s", "used": "used"}
    df = spark.createDataFrame(list(words.items()), "w string, s string")
    got = {r["w"]: r["t"] for r in df.select("w", P.stem(F.col("w")).alias("t")).collect()}
    assert got == words
    assert df.limit(1).select(P.tokenize(F.lit("Failed blk_1: 3 Errors!"))).first()[0] == ["fail", "blk_1", "3", "error"]


def test_triage_query_asks_for_all_rounds(spark, monkeypatch):
    asked, whole = [], D.GBTClassifier

    def short(**params):
        asked.append(params["maxIter"])
        return whole(**params | {"maxIter": 1})

    monkeypatch.setattr(D, "GBTClassifier", short)
    assert QUERIES["d14_triage_model"](spark, "/root/testdata/sf0.001").count() > 0
    assert asked == [300]


def test_boosted_triage_runs_300_rounds_on_separable_rows(spark):
    rows = spark.range(0, 40, 1, 1).select(
        "id", F.col("id").alias("ts"), (F.col("id") % 2 == 1).alias("y"),
        *[F.when(F.lit(c == "dest_port"), F.col("id") % 2).otherwise(0).alias(c) for c in D.FLOW_FEATURES])
    scored = D.boosted_triage(durable(rows), "ts", "id", "y").select("y", "score", "flag").distinct().collect()
    margin = 1.0
    for _ in range(299):
        margin += 0.05 * 4 / (1 + math.exp(2 * margin))
    high = 1 / (1 + math.exp(-2 * margin))
    assert {r["y"]: round(r["score"], 6) for r in scored} == {True: round(high, 6), False: round(1 - high, 6)}
    assert all(r["flag"] == r["y"] for r in scored)


def test_boosted_fits_run_side_by_side_on_dealt_rows(spark, monkeypatch):
    assert [D.boosting_parts(n, 8) for n in (0, 50_000, 50_001, 10_000_000, 100_000_000)] == [1, 1, 2, 8, 50]
    rng = random.Random(8)
    rows = [(i, i * 7 % 300, rng.random() < 0.4) for i in range(300)]
    flows = spark.createDataFrame(rows, "flow_id long, at long, alerted boolean").select(
        "flow_id", F.timestamp_seconds("at").alias("start_ts"), "alerted",
        *[(F.col("alerted").cast("int") * 3 + F.col("flow_id") % (i + 2)).alias(c) for i, c in enumerate(D.FLOW_FEATURES)])
    plain = {r["flow_id"]: (r["score"], r["threshold"]) for r in D.boosted_triage(flows, "start_ts", "flow_id", "alerted", 2).collect()}
    both, parts = threading.Barrier(2, timeout=60), []

    class Meeting(D.GBTClassifier):
        def fit(self, train):
            both.wait()
            parts.append(train.rdd.getNumPartitions())
            return super().fit(train)

    monkeypatch.setattr(D, "GBTClassifier", Meeting)
    monkeypatch.setattr(D, "BOOST_ROWS", 100)
    dealt = {r["flow_id"]: (r["score"], r["threshold"]) for r in D.boosted_triage(flows, "start_ts", "flow_id", "alerted", 2).collect()}
    assert parts == [3, 3] and dealt.keys() == plain.keys() and len(dealt) == 90
    assert all(math.isclose(a, b, abs_tol=1e-9) for i in dealt for a, b in zip(dealt[i], plain[i]))


def test_forest_scores_equal_a_walk_from_node_to_node(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, x)) for i, x in enumerate(np.round(rng.normal(size=(90, 3)), 1))] + [(90, None, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    forest = D.fit_isolation_forest(df.filter("a IS NOT NULL"), ["a", "b", "c"], "id", trees=7, sample=32)
    got = {r["id"]: r["score"] for r in D.score_isolation_forest(df, ["a", "b", "c"], forest).collect()}
    norm = float(D._unsuccessful_search(32))
    for key, *x in rows:
        depth = 0.0
        for tree in forest:
            nodes, at, steps = tree.to_dict("records"), 0, 0
            while nodes[at]["left"] >= 0:
                value = x[nodes[at]["feature"]]
                at = nodes[at]["left" if value is not None and value <= nodes[at]["cut"] else "right"]
                steps += 1
            depth += steps + float(D._unsuccessful_search(nodes[at]["size"]))
        assert math.isclose(got[key], 2 ** (-depth / 7 / norm), rel_tol=1e-12)


def test_protocol_scores_rows_once(spark, monkeypatch):
    read, whole = [], M.binary_metrics
    monkeypatch.setattr(M, "binary_metrics", lambda df, *names: read.append(df.inputFiles()) or whole(df, *names))
    QUERIES["d5_detector_protocol"](spark, "/root/testdata/sf0.001")
    assert len(read) == 3 and all(read)


def test_risk_of_asked_keys_equals_that_of_all(spark):
    rng = random.Random(6)
    scores = spark.createDataFrame([(k, rng.random() < 0.4, rng.choice(["train", "test"])) for k in range(60)], "k int, y boolean, split string")
    placed = sorted({(rng.randrange(58), rng.randrange(9)) for _ in range(200)})
    placement = spark.createDataFrame([*placed, (70, 3), (None, 1)], "k int, host int")
    whole = {r["k"]: r["host_risk"] for r in D.neighbour_risk(scores, placement, "k", "host").collect()}
    some = scores.filter("k % 7 = 2")
    repeated = placement.union(placement).join(some.select("k"), "k", "left_semi")
    got = {r["k"]: r["host_risk"] for r in D.neighbour_risk(scores, placement, "k", "host", asked=(some, repeated)).collect()}
    assert got == {k: r for k, r in whole.items() if k % 7 == 2} and len(got) == 9
