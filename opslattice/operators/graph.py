"""Graph operators on edge tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslattice.functions.parsing import crosses_subnet, subnet16
from opslattice.operators.relational import top_per_key
from opslattice.operators.sessions import one_row
from opslattice.plans.runtime import durable, written
from opslattice.plans.skew import HOT_ROWS, hot_counts, hot_keys, pairs_within, replicate_rows, salt_rows, salted_join, with_salts


def cooccurrence_edges(placement: DataFrame, item: str, member: str, labels: DataFrame | None = None,
                       label: str = "is_anomaly", hot_rows: int = 10_000) -> DataFrame:
    """Edges between members that share items: shared count n, anomalous share, weight 1/n. The placement may repeat rows.

    The label joins before pairing, while there is one row per placement. Where no item is hot, rows are dealt by item once, for the
    distinct ones, the label and the pairs.
    """
    placed = placement.select(item, member).filter(F.col(item).isNotNull())
    hot = not hot_keys(placed, [item], hot_rows).isEmpty()
    base = (placed if hot else placed.repartition(item)).distinct()
    if labels is None:
        base = base.withColumn("_y", F.lit(False))
    else:
        base = base.join(labels.select(item, F.col(label).alias("_y")).hint("shuffle_hash"), item)
    pairs = pairs_within(base, item, member, ("_y",), hot_rows, split=hot)
    return (
        pairs.groupBy(F.col("a").alias("src"), F.col("b").alias("dst"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("_y").alias("n_pos"))
        .withColumn("weight", 1.0 / F.col("n"))
    )


def both_directions(edges: DataFrame, *carry: str) -> DataFrame:
    forth = edges.select("src", "dst", *carry)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *carry)
    return forth.union(back)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("a"),
        F.sum(F.xxhash64(F.lit(1), "v", "u").cast("decimal(20,0)")).alias("b"),
    ).first()
    return row["n"], row["a"], row["b"]


def _with_minimum(edges: DataFrame, rows: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """At most `rows` edges (u, v) with the smallest neighbour m of u, hubs split; and (u, m)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_d"))
    hubs = hot_counts(least, ["u"], "_d", hot_rows, rows)
    return salted_join(edges, least.select("u", "m"), ["u"], "v", hot=hubs), least


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", vertices: DataFrame | None = None,
                         vertex: str = "id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, component): the smallest id of the component; isolated vertices keep their own.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which need
    O(log^2 n) rounds whatever the diameter. Every round is written to the checkpoint
    folder, and stops when a round changes nothing.
    """
    state = durable(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .filter(F.col("u") != F.col("v")).distinct()
    )
    before = _fingerprint(state)
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, _least = _with_minimum(both, 2 * before[0], hot_rows)
        large = durable(near.filter(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        near, least = _with_minimum(large, 2 * before[0], hot_rows)
        small = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        after = _fingerprint(state)
        if after == before:
            break
        before = after
    labels = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if vertices is None:
        roots = state.select(F.col("v").alias("id")).distinct()
        return labels.union(roots.select("id", F.col("id").alias("component")))
    return vertices.select(F.col(vertex).alias("id")).join(labels, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))


class Adjacency(NamedTuple):
    """Links (src, dst, ...) in both directions, the links of a hub spread over several salts by neighbour."""
    links: DataFrame
    hubs: DataFrame

    def around(self, frontier: DataFrame, vertex: str = "id", small: bool = False) -> DataFrame:
        """Columns of the frontier and of the links of its vertices; a row at a hub goes to each of the hub's salts.

        A small frontier is sent to the links, which then stay where they are.
        """
        if small:
            return self.links.drop("_salt").join(F.broadcast(frontier.withColumn("src", F.col(vertex))), "src")
        copies = replicate_rows(frontier.withColumn("src", F.col(vertex)), self.hubs, ["src"])
        return copies.join(self.links, ["src", "_salt"]).drop("_salt")


def adjacency(edges: DataFrame, *carry: str, hot_rows: int = HOT_ROWS) -> Adjacency:
    """Undirected edges made ready for many expansions: written once, hubs found once."""
    links = both_directions(edges, *carry)
    links = links.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in carry]) if carry else links.distinct()
    links = durable(links)
    hubs = durable(hot_keys(links, ["src"], hot_rows))
    return Adjacency(durable(salt_rows(links, hubs, ["src"], F.col("dst"))) if not hubs.isEmpty() else links.withColumn("_salt", F.lit(0)), hubs)


def _next_layer(graph: Adjacency, newest: DataFrame, before: DataFrame | None) -> DataFrame:
    """(root, id): vertices one step beyond the newest layer.

    Links go both ways, so a neighbour of a layer is in the layer before, in the layer itself or in the next one.
    """
    step = graph.around(newest).select("root", F.col("dst").alias("id")).distinct().join(newest, ["root", "id"], "left_anti")
    return step if before is None else step.join(before, ["root", "id"], "left_anti")


def k_hop(edges: DataFrame, sources: DataFrame, k: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(source, id, hops) for every vertex within k hops of a source; edges are undirected.

    `sources` has one column `source`. Each round expands only the newest vertices.
    """
    graph = adjacency(edges, hot_rows=hot_rows)
    before, newest = None, sources.select(F.col("source").alias("root"), F.col("source").alias("id")).distinct()
    reached = newest.withColumn("hops", F.lit(0))
    for hop in range(1, k + 1):
        before, newest = newest, durable(_next_layer(graph, newest, before))
        if newest.isEmpty():
            break
        reached = reached.union(newest.withColumn("hops", F.lit(hop)))
    return reached.withColumnRenamed("root", "source")


FEW = 500_000  # vertices that are sent to all links at once; more are joined by a shuffle of the links
SHORTCUTS = 8  # composed links that a vertex keeps per doubling
TIE = 1e-12  # relative difference below which two path lengths are equal


def _composed(links: DataFrame, known: DataFrame) -> DataFrame:
    """Paths of two links as shortcuts, the SHORTCUTS cheapest of each vertex, where they are not known already."""
    cheap = top_per_key(links.select("src", "dst", "weight"), "src", [F.asc("weight"), F.asc("dst")], SHORTCUTS).drop("rank")
    onward = cheap.select(F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("weight").alias("_further"))
    twice = cheap.join(onward, "dst").filter(F.col("src") != F.col("_to")).groupBy("src", F.col("_to").alias("dst")).agg(
        F.min(F.col("weight") + F.col("_further")).alias("weight"))
    new = twice.join(known.select("src", "dst"), ["src", "dst"], "left_anti")
    return top_per_key(new, "src", [F.asc("weight"), F.asc("dst")], SHORTCUTS).drop("rank")


def shortest_paths(edges: DataFrame, source, hot_rows: int = HOT_ROWS, patience: int = 8) -> DataFrame:
    """(id, dist, pred) from one source over undirected edges with weight >= 0.

    The edges are written once, in one direction. Relaxation rounds expand only vertices whose distance fell; up to FEW vertices are
    sent to the links, for more the links are shuffled and hubs are split. After every `patience` rounds without an end
    pairs of links are composed to shortcuts, so that a round reaches twice as far and a long chain needs rounds in proportion to the
    logarithm of its length. Among equal paths the smallest predecessor wins; with shortcuts paths are equal if they differ by
    less than 1e-12 of their length, as sums then depend on the order of their terms.
    """
    spark = edges.sparkSession
    links = both_directions(written(edges.select("src", "dst", "weight"), "links"), "weight")
    hubs = durable(hot_keys(links, ["src"], hot_rows))
    graph = Adjacency(links.withColumn("_salt", F.lit(0)) if hubs.isEmpty() else salt_rows(links, hubs, ["src"], F.col("dst")), hubs)
    id_type = links.schema["src"].dataType.simpleString()
    start = spark.createDataFrame([(source, 0.0)], f"id {id_type}, d double")
    known, changed, shortcuts, newest, rounds, size, frontier = start, start, None, links, 0, 1, 1
    while True:
        steps = graph.around(changed, small=frontier <= FEW).select(F.col("dst").alias("id"), (F.col("d") + F.col("weight")).alias("d"))
        if shortcuts is not None:
            steps = steps.union(changed.join(shortcuts, changed["id"] == shortcuts["src"]).select(
                F.col("dst").alias("id"), F.col("d") + F.col("weight")))
        if size <= FEW:  # an offer that is no better need not be sent anywhere
            steps = steps.join(F.broadcast(known.select("id", F.col("d").alias("_best"))), "id", "left").filter(
                F.col("_best").isNull() | (F.col("d") < F.col("_best"))).drop("_best")
        offers = steps.groupBy("id").agg(F.min("d").alias("d"))
        merged = (
            known.select("id", "d", F.col("d").alias("old"))
            .union(offers.select("id", "d", F.lit(None).cast("double").alias("old")))
            .groupBy("id").agg(F.min("d").alias("d"), F.min("old").alias("old"))
        )
        known = durable(merged)
        fell = F.col("d") < F.col("old") * (1 - (0 if shortcuts is None else TIE))
        changed = known.filter(F.col("old").isNull() | fell).select("id", "d")
        size, frontier = known.count(), changed.count()
        if frontier == 0:
            break
        rounds += 1
        if rounds % patience == 0:
            newest = durable(_composed(newest, links if shortcuts is None else links.unionByName(shortcuts)))
            shortcuts = newest if shortcuts is None else shortcuts.unionByName(newest)
    reached = known.select("id", F.col("d").alias("dist"))
    via = graph.around(reached.select("id", F.col("dist").alias("_via")), small=size <= FEW).select("src", "dst", "weight", "_via")
    length = F.col("_via") + F.col("weight")
    exact = length == F.col("dist") if shortcuts is None else F.abs(length - F.col("dist")) <= TIE * F.greatest(length, F.col("dist"))
    ends = reached.select("id", "dist")
    preds = via.join(F.broadcast(ends) if size <= FEW else ends, F.col("dst") == F.col("id")).filter(exact).groupBy("id").agg(F.min("src").alias("pred"))
    return reached.join(preds, "id", "left").select(
        "id", "dist", F.when(F.col("id") != F.lit(source), F.col("pred")).alias("pred"))


def path_to(tree: DataFrame, source) -> DataFrame:
    """(id, dist, path): vertices from the source to id, following predecessors."""
    tree = durable(tree)
    done = tree.filter(F.col("id") == F.lit(source)).select("id", "dist", F.array("id").alias("path"))
    frontier = done
    while True:
        step = tree.join(frontier.select(F.col("id").alias("pred"), "path"), "pred").select(
            "id", "dist", F.concat("path", F.array("id")).alias("path"))
        frontier = durable(step)
        if frontier.isEmpty():
            return done
        done = done.union(frontier)


def bounded_shortest_path(edges: DataFrame, pairs: DataFrame, limit: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(src, dst, hops) for the pairs that are connected within `limit` hops; edges are undirected.

    Pairs with a link of their own are found by looking the link up, before any layer is made. For the others the search starts at both
    ends and the ends take turns. Two layers a and b steps away from the ends meet if and only if the ends are a + b
    hops apart or closer, and the first time they do they are a + b apart. A pair that has met leaves, and a layer is carried on only for ends that
    still have an open pair, so a round holds the layers of open pairs: half the radius instead of the whole.
    """
    graph = adjacency(edges, hot_rows=hot_rows)
    still = durable(pairs.select("src", "dst").dropna().distinct())
    met = durable(still.filter(F.col("src") == F.col("dst")).withColumn("hops", F.lit(0)))
    still = durable(still.filter(F.col("src") != F.col("dst")))
    if limit < 1 or still.isEmpty():
        return met
    linked = durable(still.join(graph.links.select("src", "dst"), ["src", "dst"], "left_semi").withColumn("hops", F.lit(1)))
    met = met.union(linked)
    still = durable(still.join(linked, ["src", "dst"], "left_anti"))
    layers = {}
    for end in ("src", "dst"):
        layers[end] = (None, still.select(F.col(end).alias("root"), F.col(end).alias("id")).distinct())
    for hops in range(1, limit + 1):
        if still.isEmpty():
            break
        end, other = ("src", "dst") if hops % 2 else ("dst", "src")
        before, newest = layers[end]
        wanted = still.select(F.col(end).alias("root")).distinct()
        newest = newest.join(wanted, "root", "left_semi")
        layers[end] = (newest, durable(_next_layer(graph, newest, before)))
        if hops == 1:
            continue
        found = durable(_meeting(still, layers[end][1], layers[other][1], end, other).withColumn("hops", F.lit(hops)))
        met = met.union(found)
        still = durable(still.join(found, ["src", "dst"], "left_anti"))
    return met


def _meeting(pairs: DataFrame, here: DataFrame, there: DataFrame, end: str, other: str) -> DataFrame:
    """(src, dst): the pairs whose layers share a vertex. Each pair lists the smaller of its two layers and looks it up in the other."""
    sized = pairs
    for layer, name, size in ((here, end, "_here"), (there, other, "_there")):
        sized = sized.join(layer.groupBy(F.col("root").alias(name)).agg(F.count(F.lit(1)).alias(size)), name)
    parts = []
    for listed, looked, a, b, least in ((here, there, end, other, F.col("_here") <= F.col("_there")),
                                        (there, here, other, end, F.col("_here") > F.col("_there"))):
        open_ = sized.filter(least).select("src", "dst").join(listed.select(F.col("root").alias(a), "id"), a)
        parts.append(open_.join(looked.select(F.col("root").alias(b), "id"), [b, "id"], "left_semi").select("src", "dst"))
    return parts[0].union(parts[1]).distinct()


def weighted_degree(placement: DataFrame, item: str, member: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, degree): summed weights of a member's co-occurrence edges, without listing an edge.

    Every item adds the number of its other members. Members that never share an item have no edges and are absent.
    """
    base = placement.select(item, member).distinct()
    # The sizes tell which items are hot, so they need no lookup among the hot ones.
    sizes = with_salts(base.groupBy(item).agg(F.count(F.lit(1)).alias("_size")), "_size", hot_rows)
    left = salt_rows(base, sizes.filter("_salts > 1").select(item, "_salts"), [item], F.col(member))
    right = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return left.join(right, [item, "_salt"]).groupBy(F.col(member).alias("id")).agg(
        F.sum(F.col("_size") - 1).alias("degree")).filter("degree > 0")


def peers_of(placement: DataFrame, item: str, member: str, chosen: DataFrame, labels: DataFrame | None = None,
             label: str = "is_anomaly") -> DataFrame:
    """(id, peer, shared, shared_anomalous) for the members in `chosen` (one column, `id`) only.

    The items of the chosen members are expanded, not those of all members: a chosen member meets each other member of its items.
    """
    base = placement.select(item, member).distinct()
    own = base.join(chosen.select(F.col("id").alias(member)).distinct(), member).select(item, F.col(member).alias("id"))
    if labels is not None:
        own = own.join(labels.select(item, F.col(label).alias("_y")), item)
    else:
        own = own.withColumn("_y", F.lit(False))
    met = salted_join(base, own, [item], member).filter(F.col(member) != F.col("id"))
    return met.groupBy("id", F.col(member).alias("peer")).agg(
        F.count(F.lit(1)).alias("shared"), F.count_if("_y").alias("shared_anomalous"))


def hotspot_peers(peers: DataFrame, k: int = 5) -> DataFrame:
    """The k heaviest peers: shared anomalous, then shared, then id."""
    return peers.select("peer", "shared", "shared_anomalous").orderBy(F.desc("shared_anomalous"), F.desc("shared"), "peer").limit(k)


def graph_stats(vertices: DataFrame, edges: DataFrame, transfers: DataFrame, rereplication: DataFrame) -> DataFrame:
    """Size, density, subnets, self-loop transfers and cross-subnet re-replications."""
    ips = vertices.agg(F.count(F.lit(1)).alias("vertices"), F.countDistinct(subnet16(F.col("ip"))).alias("subnets"))
    links = edges.agg(F.count(F.lit(1)).alias("edges"))
    loops = transfers.agg(F.count_if(F.col("src_ip") == F.col("dst_ip")).alias("self_loops"))
    cross = rereplication.agg(
        F.count(F.lit(1)).alias("rereplications"),
        F.count_if(crosses_subnet(F.col("src_ip"), F.col("dst_ip"))).alias("cross_subnet"))
    n = F.col("vertices")
    return one_row([ips, links, loops, cross]).withColumn(
        "density", F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(F.lit(0.0)))


def property_graph_nodes(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, id): one row per node, merged by key within its kind."""
    out = None
    for kind, (df, key) in frames.items():
        part = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")).dropna().distinct()
        out = part if out is None else out.union(part)
    return out


def property_graph_edges(frames: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(type, src, dst, n): one row per edge; n counts the merged source rows."""
    out = None
    for kind, (df, src, dst) in frames.items():
        part = df.select(F.lit(kind).alias("type"), F.col(src).cast("string").alias("src"),
                         F.col(dst).cast("string").alias("dst")).dropna()
        out = part if out is None else out.union(part)
    return out.groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- properties
def node_writes(df: DataFrame, kind: str, key: str, properties: dict[str, Column] | None = None, order: Column | None = None) -> DataFrame:
    """(kind, id, order, properties): one write per row; properties are text, null ones are not written."""
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), _order_and_properties(properties, order)).select(
        "kind", "id", "_w.*").filter("id IS NOT NULL")


def edge_writes(df: DataFrame, kind: str, src: str, dst: str, key: dict[str, Column] | None = None,
                properties: dict[str, Column] | None = None, order: Column | None = None) -> DataFrame:
    """(type, src, dst, key, order, properties): one write per row.

    Edges of one type between the same two nodes are one edge if their key properties are equal, such as port and protocol of a flow.
    """
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(""))) for name, value in (key or {}).items()]
    return df.select(
        F.lit(kind).alias("type"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"),
        F.concat_ws(";", *parts).alias("key"), _order_and_properties(properties, order)).select(
        "type", "src", "dst", "key", "_w.*").filter("src IS NOT NULL AND dst IS NOT NULL")


def _order_and_properties(properties: dict[str, Column] | None, order: Column | None) -> Column:
    pairs = [x for name, value in (properties or {}).items() for x in (F.lit(name), value.cast("string"))]
    known = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct((F.lit(0) if order is None else order).cast("bigint").alias("order"), known.cast("map<string,string>").alias("properties")).alias("_w")


def merged(writes: DataFrame) -> DataFrame:
    """One row per key with `properties` (map) and `order` (of the last write): every property has the value that was written last.

    All columns but order and properties are the key. A property that a later write leaves out or null keeps its value; of writes with
    the same order the larger value stays. Merging merged rows again, or with the writes they come from, changes nothing that is in both.
    """
    keys = [c for c in writes.columns if c not in ("order", "properties")]
    entries = writes.select(*keys, "order", F.explode_outer("properties").alias("_name", "_value"))
    last = entries.groupBy(*keys, "_name").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("order", "_value"))).alias("_value"), F.max("order").alias("order"))
    known = F.col("_name").isNotNull() & F.col("_value").isNotNull()
    # As many entries as a key has property names.
    return last.groupBy(*keys).agg(F.max("order").alias("order"), F.map_from_entries(F.array_sort(F.collect_list(
        F.when(known, F.struct(F.col("_name").alias("key"), F.col("_value").alias("value")))))).alias("properties"))


def properties_text(properties: Column) -> Column:
    """'name=value;...' by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
