"""Skew helpers and order statistics against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opslattice.operators.metrics import binary_metrics
from opslattice.plans import ranks, skew
from opslattice.plans.runtime import durable


def hot_rows(seed=1, n=400):
    """Rows of which a third share one key; keys include null."""
    rng = random.Random(seed)
    return [(i, "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None]), rng.randint(0, 90), rng.randint(0, 9)) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(hot_rows(), "id int, key string, t int, v int")
    return df.withColumn("bucket", F.floor(F.col("t") / 7))


def by_key():
    groups = defaultdict(list)
    for i, key, t, v in hot_rows():
        groups[key].append((t, i, v))
    return {k: sorted(g) for k, g in groups.items()}


def test_history_crosses_buckets(table):
    out = {r["id"]: list(r["history"]) for r in skew.history(table, ["key"], "bucket", ["t", "id"], "v", 5).collect()}
    assert len(out) == 400
    for rows in by_key().values():
        for at, (_, i, _v) in enumerate(rows):
            assert out[i] == [v for _, _, v in rows[max(0, at - 5):at]]


def test_previous_numbered_and_last_seen(table):
    prev = {r["id"]: r["prev"] for r in skew.previous(table, ["key"], "bucket", ["t", "id"], ["id", "t"]).collect()}
    pos = {r["id"]: r["pos"] for r in skew.numbered(table, ["key"], "bucket", ["t", "id"]).collect()}
    marked = table.withColumn("mark", F.when(F.col("v") == 0, F.col("id")))
    seen = {r["id"]: r["seen"] for r in skew.last_seen(marked, ["key"], "bucket", ["t", "id"], "mark", "seen").collect()}
    for rows in by_key().values():
        latest = None
        for at, (_, i, v) in enumerate(rows):
            assert pos[i] == at + 1
            assert (prev[i]["id"] if prev[i] else None) == (rows[at - 1][1] if at else None)
            latest = i if v == 0 else latest
            assert seen[i] == latest


def test_bursts_are_cut_and_windows_cross_the_cuts(spark):
    rng = random.Random(2)
    rows = [(i, "burst" if i % 3 else rng.choice(["a", None]), 5 if i % 3 else rng.randint(0, 20), rng.randint(0, 9)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, key string, t int, v int").withColumn("bucket", F.floor(F.col("t") / 7)).repartition(5)
    cut = skew.split_bursts(df, ["key"], "bucket", ["t", "id"], hot_rows=50)
    sizes = {tuple(r[:3]): r["n"] for r in cut.groupBy("key", "bucket.bucket", "bucket.piece").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(sizes.values()) == 600 and sum(k[0] == "burst" for k in sizes) >= 5 and max(sizes.values()) < 200
    groups = defaultdict(list)
    for i, key, t, v in rows:
        groups[key].append((t, i, v))
    prev = {r["id"]: r["prev"] for r in skew.previous(cut, ["key"], "bucket", ["t", "id"], ["id"]).collect()}
    hist = {r["id"]: list(r["history"]) for r in skew.history(cut, ["key"], "bucket", ["t", "id"], "v", 4).collect()}
    total = {r["id"]: r["total"] for r in skew.totalled(cut, ["key"], "bucket", ["t", "id"], "v", "total").collect()}
    for group in groups.values():
        group.sort()
        for at, (_, i, _v) in enumerate(group):
            assert (prev[i]["id"] if prev[i] else None) == (group[at - 1][1] if at else None)
            assert hist[i] == [v for _, _, v in group[max(0, at - 4):at]]
            assert total[i] == sum(v for _, _, v in group[:at + 1])


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, table, how):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3), (None, 4)], "key string, w int")
    plain = sorted(table.join(lookup, "key", how).select("id", "w").collect())
    salted = skew.salted_join(table, lookup, ["key"], "id", how, hot_rows=50)
    assert sorted(salted.select("id", "w").collect(), key=str) == sorted(plain, key=str)
    assert skew.hot_keys(table, ["key"], 100).filter("key = 'hot'").count() == 1


def test_hot_keys_are_few_and_spread_by_size(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARES", 10)
    df = spark.range(1000).selectExpr("CASE WHEN id < 500 THEN -1 WHEN id < 700 THEN -2 ELSE id % 100 END AS key")
    found = {r["key"]: r["_salts"] for r in skew.hot_keys(df, ["key"], 3).collect()}
    assert found == {-1: 6, -2: 3}  # 100 rows are a tenth of all
    assert {r["key"] for r in skew.hot_keys(df, ["key"], 300).collect()} == {-1}


def test_pairs_within_splits_hot_items(spark):
    rng = random.Random(3)
    placed = {("big", m) for m in range(40)} | {(f"i{rng.randint(0, 20)}", rng.randint(0, 40)) for _ in range(150)}
    df = spark.createDataFrame([(i, m, i == "big") for i, m in placed], "item string, member int, y boolean")
    got = sorted(tuple(r) for r in skew.pairs_within(df, "item", "member", ("y",), hot_rows=10).collect())
    want = sorted((i, a, b, i == "big") for i, a in placed for j, b in placed if i == j and a < b)
    assert got == want


@pytest.mark.parametrize("band,pivots", [(5_000, 24), (10, 4), (10, 200)])
def test_kth_smallest_and_percentile(spark, band, pivots):
    rng = random.Random(5)
    values = [rng.choice([7.0, rng.uniform(-50, 50), float(rng.randint(0, 5))]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ordered = sorted(values)
    for k in (0, 17, 250, 499):
        found = ranks.kth_smallest(df, "x", k, band, pivots)
        assert found.value == ordered[k]
        assert found.below == sum(v < ordered[k] for v in values)
    rank = 0.96 * 499
    expected = ordered[math.floor(rank)] + (rank % 1) * (ordered[math.ceil(rank)] - ordered[math.floor(rank)])
    assert ranks.exact_percentile(df, "x", 0.96) == pytest.approx(expected)
    with pytest.raises(ValueError):
        ranks.kth_smallest(df, "x", 500)


def test_order_values_of_other_types_and_limits(spark):
    rng = random.Random(6)
    names = [f"blk_{rng.randint(0, 300)}" for _ in range(400)] + ["é", "", "zz"]
    df = spark.createDataFrame([(v,) for v in names], "k string")
    for k in (0, 100, 402):
        found = ranks.kth_smallest(df, "k", k, 10, 4)
        assert (found.value, found.below) == (sorted(names)[k], sum(v < sorted(names)[k] for v in names))
    odd = [math.inf, -math.inf, math.nan, math.nan, 1.0, 2.0, -0.0, 0.0]
    df = spark.createDataFrame([(v,) for v in odd], "x double")
    for band in (5_000, 1):
        _, found = ranks.order_values(df, "x", lambda n: list(range(n)), band, 2)
        assert [f.value for f in found[:6]] == [-math.inf, 0.0, 0.0, 1.0, 2.0, math.inf] and math.isnan(found[6].value) and found[7].below == 6
    assert ranks.order_values(df.limit(0), "x", lambda n: [])[0] == 0 and ranks.exact_percentile(df.limit(0), "x", 0.5) is None
    one = spark.createDataFrame([(7,)] * 300, "x int")
    assert ranks.kth_smallest(one, "x", 299, 10, 4) == (7, 0)


def test_selection_does_not_shuffle_the_column(spark):
    df = spark.range(100_000).withColumn("x", F.rand(3))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert ranks.kth_smallest(df, "x", 70_000).below == 70_000
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) < 30


def test_selection_reads_the_plan_above_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    df = spark.createDataFrame(spark.range(3_000, numPartitions=3).rdd.mapPartitions(count), "id long")
    assert ranks.exact_percentile(df, "id", 0.5, band=20) == 1499.5
    assert seen.value == 3_000


def test_positions_without_a_single_window(spark):
    rng = random.Random(12)
    ids = [None, "", *{f"k{rng.randint(0, 10**6)}" for _ in range(500)}]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(rng.sample(ids, len(ids)))], "k string, n int")
    got = {r["k"]: r["pos"] for r in ranks.positions(df.repartition(5), ["k"]).collect()}
    assert got == {v: i for i, v in enumerate([None, *sorted(v for v in ids if v is not None)], 1)}


def test_metrics_of_an_empty_frame(spark):
    empty = spark.createDataFrame([], "y boolean, s double, f boolean")
    rows = binary_metrics(empty, "y", "s", "f").collect()
    assert len(rows) == 1 and rows[0]["flagged"] == 0 and rows[0]["roc_auc"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(9)
    rows = [(float(s), rng.randint(0, 4), rng.randint(0, 4)) for s in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "s double, a int, b int")
    got = {r["s"]: (r["cum_a"], r["cum_b"]) for r in ranks.running_totals(df, "s", ["a", "b"], descending).collect()}
    a = b = 0
    for s, da, db in sorted(rows, reverse=descending):
        a, b = a + da, b + db
        assert got[s] == (a, b)


def test_durable_cuts_lineage(spark):
    df = durable(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 90
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_fanning_join_spreads_a_small_hot_key(spark):
    rows = [(i % 3, i) for i in range(90)] + [(None, 7), (0, 3)]
    lookup = [(k % 4, k) for k in range(20)] + [(None, 1)]
    left, right = spark.createDataFrame(rows, "k int, a int"), spark.createDataFrame(lookup, "k int, b int")
    joined = skew.fanning_join(left, right, ["k"], "a")
    assert sorted((r["k"], r["a"], r["b"]) for r in joined.collect()) == sorted((k, a, b) for k, a in rows for x, b in lookup if k is not None and k == x)
    shares = joined.groupBy(F.spark_partition_id()).count().collect()
    assert joined.rdd.getNumPartitions() == skew.FAN_TASKS and max(r["count"] for r in shares) < joined.count() / 4


def test_unset_settings_leave_the_session_its_own(spark):
    from opslattice.plans.runtime import UNSET_CONF, tune

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.get(k, None) for k in UNSET_CONF}
    try:
        spark.conf.set(key, "3m")
        for k in UNSET_CONF:
            if k != key:
                spark.conf.unset(k)
        tune(spark)
        assert spark.conf.get(key) == "3m"
        assert all(spark.conf.get(k) == v for k, v in UNSET_CONF.items() if k != key)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tune_bounds_file_splits_unless_the_session_does(spark):
    from opslattice.plans.runtime import tune

    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        tune(spark)
        assert spark.conf.get(key) == "32m"
        spark.conf.set(key, "16m")
        tune(spark)
        assert spark.conf.get(key) == "16m"
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
