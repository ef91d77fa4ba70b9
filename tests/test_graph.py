"""Graph and incident operators against independent implementations."""

import heapq
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from opslattice.operators import graph as G
from opslattice.operators import timeseries as TS


def components(vertices, edges):
    adj = {v: set() for v in vertices}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    label = {}
    for v in sorted(vertices):
        if v in label:
            continue
        queue = deque([v])
        label[v] = v
        while queue:
            for w in adj[queue.popleft()]:
                if w not in label:
                    label[w] = v
                    queue.append(w)
    return label


@pytest.mark.parametrize("seed", range(3))
def test_k_hop_and_shortest_paths(spark, seed):
    rng = random.Random(seed)
    edges = {}
    for _ in range(150):
        a, b = rng.sample(range(60), 2)
        edges[(min(a, b), max(a, b))] = rng.uniform(0.1, 5)
    adj = {}
    for (a, b), w in edges.items():
        adj.setdefault(a, {})[b] = w
        adj.setdefault(b, {})[a] = w
    source = next(iter(adj))
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src int, dst int, weight double")
    sources = spark.createDataFrame([(source,)], "source int")

    hops, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        for v in adj[u]:
            if v not in hops:
                hops[v] = hops[u] + 1
                queue.append(v)
    for k in (1, 2):
        got = {r["id"]: r["hops"] for r in G.k_hop(df, sources, k).collect()}
        assert got == {v: h for v, h in hops.items() if h <= k}

    dist, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for v, w in adj[u].items():
            if v not in dist:
                heapq.heappush(heap, (d + w, v))
    tree = G.shortest_paths(df, source)
    got = {r["id"]: r for r in tree.collect()}
    assert {v: pytest.approx(d) for v, d in dist.items()} == {v: r["dist"] for v, r in got.items()}
    assert got[source]["pred"] is None
    for row in G.path_to(tree, source).collect():
        path = row["path"]
        assert path[0] == source and path[-1] == row["id"]
        assert sum(adj[a][b] for a, b in zip(path, path[1:])) == pytest.approx(dist[row["id"]])


def test_union_find_fixture(spark):
    edges = spark.createDataFrame([(0, 1), (3, 4)], "src int, dst int")
    out = G.connected_components(edges, vertices=spark.range(5).select(F.col("id").cast("int")))
    assert {r["id"]: r["component"] for r in out.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_components_with_a_hub_and_a_chain(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 180)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    vertices = list(range(0, 270))
    df = spark.createDataFrame(edges, "src int, dst int")
    out = G.connected_components(df, vertices=spark.range(270).select(F.col("id").cast("int")), hot_rows=20)
    assert {r["id"]: r["component"] for r in out.collect()} == components(vertices, edges)


@pytest.mark.parametrize("seed", range(4))
def test_incidents_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    events = [(i, rng.uniform(0, 5000), f"s{rng.randint(0, 4)}", f"k{rng.randint(0, 5)}") for i in range(120)]
    links = [(a[0], b[0]) for a in events for b in events if a[0] < b[0] and abs(a[1] - b[1]) <= 300 and (a[2] == b[2] or a[3] == b[3])]
    df = spark.createDataFrame(events, "id int, s double, src string, k2 string").withColumn(
        "ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint")))
    listed = [tuple(r) for r in TS.links_in_window(df, "id", "ts", ["src", "k2"], 300, hot_rows=5).collect()]
    assert len(listed) == len(set(listed)) and {tuple(sorted(p)) for p in listed} == set(links)
    assert all((events[a][1], a) < (events[b][1], b) for a, b in listed)
    out = TS.correlate_incidents(df, "id", "ts", ["src", "k2"], 300, bucket_s=200, hot_rows=[1_000_000, 10][seed % 2])
    assert {r["id"]: r["incident"] for r in out.collect()} == components(range(120), links)
    stats = TS.incident_stats(out).first()
    assert stats["events"] == 120
    per_key = {r["id"]: r["partners"] for r in TS.partners_in_window(df, "src", "ts", "id", 300).collect()}
    for i, s, src, _k in events:
        assert per_key[i] == sum(1 for j, t, other, _ in events if other == src and 0 <= s - t <= 300 and (t, j) < (s, i))


def test_gap_of_exactly_the_window_links(spark):
    df = spark.sql("SELECT id, timestamp_seconds(t) AS ts, 'a' AS key FROM VALUES (1, 0), (2, 1800), (3, 3601) v(id, t)")
    runs = {r["id"]: r["run"] for r in TS.key_runs(df, "key", "ts", "id", 1800).collect()}
    assert runs == {1: 1, 2: 1, 3: 3}


def test_burst_is_strict_and_constant_series_has_none(spark):
    flat = spark.createDataFrame([(i, 5) for i in range(9)], "hour int, alerts int")
    assert TS.robust_z_burst(flat, "alerts").filter("burst").count() == 0
    edge = 3.5 / 0.6745
    rows = [(i, 0.0) for i in range(8)] + [(8, edge), (9, edge + 0.01)]
    out = TS.robust_z_burst(spark.createDataFrame(rows, "hour int, alerts double"), "alerts")
    assert [r["hour"] for r in out.filter("robust_z > 3.4999").orderBy("hour").collect()] == [8, 9]
    assert 9 in [r["hour"] for r in out.filter("burst").collect()]


@pytest.mark.parametrize("seed, limit, hot", [(1, 4, 1_000_000), (2, 3, 5), (3, 5, 5), (4, 1, 5)])
def test_bounded_paths_meet_in_the_middle(spark, seed, limit, hot):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(90)} | {(0, i) for i in range(1, 25)}
    pairs = {(rng.randrange(80), rng.randrange(85)) for _ in range(150)} | {(3, 3)}
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)

    def hops(a, b):
        seen, layer = {a}, {a}
        for h in range(limit + 1):
            if b in layer:
                return h
            layer = {w for v in layer for w in adj.get(v, ())} - seen
            seen |= layer
        return None

    out = G.bounded_shortest_path(spark.createDataFrame(sorted(edges), "src int, dst int"),
                                  spark.createDataFrame([*sorted(pairs), (None, 1)], "src int, dst int"), limit, hot)
    expected = {(a, b, hops(a, b)) for a, b in pairs if hops(a, b) is not None}
    assert out.count() == len(expected) and {tuple(r) for r in out.collect()} == expected


def test_long_chain_with_a_hub_needs_few_rounds(spark, monkeypatch):
    rng = random.Random(8)
    weights = {(i, i + 1): rng.choice([0.1, 0.25, 1 / 3, 2.0]) for i in range(120)} | {(1000, i): 500.0 for i in range(0, 120, 3)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in weights.items()], "src int, dst int, weight double")
    dist, heap, adj = {}, [(0.0, 0)], {}
    for (a, b), w in weights.items():
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for v, w in adj[u]:
                heapq.heappush(heap, (d + w, v))
    rounds = []
    durable = G.durable
    monkeypatch.setattr(G, "durable", lambda df: rounds.append(1) or durable(df))
    got = {r["id"]: r for r in G.shortest_paths(edges, 0, hot_rows=20, patience=3).collect()}
    assert len(rounds) < 45
    assert {v: r["dist"] for v, r in got.items()} == {v: pytest.approx(d, rel=1e-11) for v, d in dist.items()}
    for v, r in got.items():
        if v:
            w = min(w for u, w in adj[v] if u == r["pred"])
            assert dist[r["pred"]] + w == pytest.approx(dist[v], rel=1e-11)


def test_degree_and_peers_without_pairs(spark):
    rng = random.Random(4)
    placed = sorted({(rng.randint(0, 30), rng.randint(0, 12)) for _ in range(120)}) + [(99, 77)]
    bad = {i for i in range(31) if rng.random() < 0.3}
    df = spark.createDataFrame(placed + placed[:5], "item int, member int")
    labels = spark.createDataFrame([(i, i in bad) for i in {i for i, _ in placed}], "item int, is_anomaly boolean")
    shared = {}
    for i, a in placed:
        for j, b in placed:
            if i == j and a != b:
                n, y = shared.get((a, b), (0, 0))
                shared[a, b] = (n + 1, y + (i in bad))
    degree = {r["id"]: r["degree"] for r in G.weighted_degree(df, "item", "member").collect()}
    assert degree == {a: sum(n for (x, _), (n, _y) in shared.items() if x == a) for a in {a for a, _ in shared}}
    chosen = spark.createDataFrame([(3,), (5,), (77,)], "id int")
    got = {(r["id"], r["peer"]): (r["shared"], r["shared_anomalous"]) for r in G.peers_of(df, "item", "member", chosen, labels).collect()}
    assert got == {k: v for k, v in shared.items() if k[0] in (3, 5)}
    plan = G.weighted_degree(df, "item", "member")._jdf.queryExecution().optimizedPlan().toString()
    assert "member#" in plan and plan.count("Join") <= 4
    top = G.hotspot_peers(G.peers_of(df, "item", "member", chosen.filter("id = 3"), labels), 3).collect()
    assert [r["peer"] for r in top] == sorted((b for a, b in shared if a == 3), key=lambda b: (-shared[3, b][1], -shared[3, b][0], b))[:3]


def test_merge_keeps_the_last_written_properties(spark):
    rng = random.Random(6)
    rows = [(f"n{rng.randint(0, 9)}", i, rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, at int, color string, size int").repartition(4)
    writes = G.node_writes(df, "N", "id", {"color": F.col("color"), "size": F.col("size")}, F.col("at"))
    want = {}
    for i, _, color, size in rows:
        node = want.setdefault(i, {})
        node.update({k: v for k, v in (("color", color), ("size", size and str(size))) if v})
    once = G.merged(writes)
    assert {r["id"]: r["properties"] for r in once.collect()} == want
    again = G.merged(once.unionByName(writes).unionByName(writes))
    assert {r["id"]: r["properties"] for r in again.collect()} == want
    edges = spark.createDataFrame([("a", "b", 80, "TCP", 3), ("a", "b", 80, "TCP", 5), ("a", "b", 53, None, 1), ("a", None, 1, "x", 1)],
                                  "s string, d string, port int, proto string, n int")
    found = G.merged(G.edge_writes(edges, "FLOW", "s", "d", {"port": F.col("port"), "proto": F.col("proto")}, {"n": F.col("n")}, F.col("n")))
    assert {(r["key"], G_text(r)) for r in found.collect()} == {("port=80;proto=TCP", "n=5"), ("port=53;proto=", "n=1")}


def G_text(row):
    return ";".join(f"{k}={v}" for k, v in sorted(row["properties"].items()))


def test_linked_pairs_need_no_layers(spark, monkeypatch):
    made = []
    layer = G._next_layer
    monkeypatch.setattr(G, "_next_layer", lambda *a: made.append(a) or layer(*a))
    edges = spark.createDataFrame([(i, j) for i in range(12) for j in range(i)], "src int, dst int")
    pairs = spark.createDataFrame([(i, (i + 1) % 12) for i in range(12)] + [(3, 3), (2, 99)], "src int, dst int")
    got = {tuple(r) for r in G.bounded_shortest_path(edges, pairs.filter("dst < 99"), 4).collect()}
    assert got == {(i, (i + 1) % 12, 1) for i in range(12)} | {(3, 3, 0)} and not made
    assert G.bounded_shortest_path(edges, pairs, 4).count() == 13 and len(made) == 4
    assert G.bounded_shortest_path(edges, pairs, 0).collect() == [(3, 3, 0)]


def test_a_pair_lists_its_smaller_layer(spark):
    here = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8)], "root int, id int")
    there = spark.createDataFrame([(10, 49), (30, 8), (30, 9), (40, 60)], "root int, id int")
    pairs = spark.createDataFrame([(1, 10), (1, 40), (2, 30), (3, 30), (5, 10)], "src int, dst int")
    assert {tuple(r) for r in G._meeting(pairs, here, there, "src", "dst").collect()} == {(1, 10), (3, 30)}


def test_degrees_with_hot_items_null_items_and_repeats(spark):
    placed = [(i % 3, i) for i in range(60)] + [(9, 1), (9, 2), (8, 77), (None, 5), (None, 6), (7, None), (7, 3)]
    df = spark.createDataFrame(placed + placed[:9], "item int, member int")
    expected = Counter()
    for i, a in placed:
        if i is not None:
            expected[a] += sum(i == j for j, _ in placed) - 1
    for hot_rows in (4, 1_000_000):
        got = {r["id"]: r["degree"] for r in G.weighted_degree(df, "item", "member", hot_rows).collect()}
        assert got == {a: n for a, n in expected.items() if n}


@pytest.mark.parametrize("hot_rows", [10_000, 4])
def test_edges_of_repeated_hot_and_null_items(spark, hot_rows):
    rng = random.Random(11)
    placed = [(rng.randint(0, 12), rng.randint(0, 9)) for _ in range(80)]
    bad = {i: rng.random() < 0.4 for i in range(12)}  # item 12 has no label
    rows = spark.createDataFrame([*placed, *placed[:20], (None, 1), (None, 2), (3, None)], "item int, member int")
    labels = spark.createDataFrame(list(bad.items()), "item int, is_anomaly boolean")
    for known, kept in ((labels, set(bad)), (None, set(range(13)))):
        expected = {}
        for i, a in set(placed):
            for b in {m for j, m in placed if j == i and m > a and i in kept}:
                n, y = expected.get((a, b), (0, 0))
                expected[a, b] = (n + 1, y + (known is not None and bad[i]))
        got = G.cooccurrence_edges(rows, "item", "member", known, hot_rows=hot_rows).collect()
        assert {(r["src"], r["dst"]): (r["n"], r["n_pos"]) for r in got} == expected and len(got) == len(expected)


def test_placements_are_dealt_by_item_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(200).select((F.col("id") % 40).alias("item"), (F.col("id") % 7).alias("member"))
        labels = spark.range(40).select(F.col("id").alias("item"), (F.col("id") % 3 == 0).alias("is_anomaly"))
        plan = G.cooccurrence_edges(rows, "item", "member", labels)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # rows and labels once for either side of the pairs, which share them when the query runs, and the edges
    assert plan.count("Exchange hashpartitioning") == 5 and "Exchange hashpartitioning(member" not in plan


@pytest.mark.parametrize("few", [500_000, 0])
def test_paths_with_few_and_with_many_vertices(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    rng = random.Random(3)
    edges = [(a, b, rng.choice([0.25, 0.5, 1.0])) for a, b in (rng.sample(range(40), 2) for _ in range(90))] + [(0, i, 2.0) for i in range(1, 30)]
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    dist, heap = {}, [(0.0, 5)]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in dist:
            dist[u] = d
            for v, w in adj[u]:
                heapq.heappush(heap, (d + w, v))
    tree = G.shortest_paths(spark.createDataFrame(edges, "src int, dst int, weight double"), 5, hot_rows=20)
    preds = {v: min(u for u, w in adj[v] if dist[u] + w == dist[v]) for v in dist if v != 5} | {5: None}
    assert {r["id"]: (r["dist"], r["pred"]) for r in tree.collect()} == {v: (d, preds[v]) for v, d in dist.items()}


def test_rounds_leave_the_links_where_they_are(spark, monkeypatch):
    plans, durable = [], G.durable
    monkeypatch.setattr(G, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or durable(df))
    edges = spark.range(300).select((F.col("id") % 50).alias("src"), (F.col("id") * 7 % 61 + 100).alias("dst"), F.lit(1.0).alias("weight"))
    assert G.shortest_paths(edges, 0, patience=100).count() > 50
    rounds = [p for p in plans if "weight" in p]
    assert rounds and all("SortMergeJoin" not in p and "Exchange hashpartitioning(src" not in p for p in rounds)
