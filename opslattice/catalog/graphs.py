"""Graph operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.catalog.base import Tables, query
from opslattice.catalog.aggregates import NODES, external_flows
from opslattice.catalog.joins import HARDWARE, KEY, PAIRS, SPLIT, split_blocks
from opslattice.catalog.parsing import REPLICAS, REREPL, TRANSFERS
from opslattice.functions import parsing as P
from opslattice.operators import graph as G
from opslattice.operators import relational as R
from opslattice.operators.sessions import one_row, parse_hardware_log, parse_log
from opslattice.plans.runtime import durable

# suppliers are neighbours if they share an order


@query("h1_cooccurrence_graph", f"SELECT src, dst, n, n_pos, round(1.0 / n, 9) AS weight FROM ({PAIRS})")
def _(t):
    edges = G.cooccurrence_edges(t("placement"), "block_no", "host", t("order_labels"))
    return edges.withColumn("weight", F.round("weight", 9))


def host_edges(t: Tables):
    return durable(G.cooccurrence_edges(t("placement"), "block_no", "host", t("order_labels")).select("src", "dst", "n", "weight"))


EDGES = f"SELECT src, dst, n, CAST(1 AS DOUBLE) / n AS weight FROM ({PAIRS})"
LINKS = f"SELECT src, dst, weight FROM ({EDGES}) UNION ALL SELECT dst, src, weight FROM ({EDGES})"


@query("h2_connected_components", f"""WITH RECURSIVE e AS MATERIALIZED ({LINKS}), c(id, r) AS (SELECT s_suppkey, s_suppkey FROM @supplier
    UNION SELECT e.dst, c.r FROM c JOIN e ON e.src = c.id) SELECT id, min(r) AS component FROM c GROUP BY 1""")
def _(t):
    return G.connected_components(host_edges(t), vertices=t("supplier").select(F.col("s_suppkey").alias("id")))


def source_host(t: Tables):
    return t("supplier").agg(F.min("s_suppkey").alias("source"))


@query("h3_k_hop", f"""WITH RECURSIVE e AS MATERIALIZED ({LINKS}), c(id, hops) AS (SELECT min(s_suppkey), 0 FROM @supplier
    UNION SELECT e.dst, c.hops + 1 FROM c JOIN e ON e.src = c.id WHERE c.hops < 2) SELECT (SELECT min(s_suppkey) FROM @supplier) AS source, id, min(hops) AS hops FROM c GROUP BY 2""")
def _(t):
    return G.k_hop(host_edges(t), source_host(t), 2)


def rounds_sql(n: int) -> str:
    steps = ["d0 AS (SELECT min(s_suppkey) AS id, CAST(0 AS DOUBLE) AS dist FROM @supplier)"]
    for i in range(n):
        steps.append(f"d{i + 1} AS MATERIALIZED (SELECT id, min(dist) AS dist FROM (SELECT id, dist FROM d{i} UNION ALL SELECT e.dst, d.dist + e.weight FROM d{i} d JOIN e ON e.src = d.id) GROUP BY 1)")
    return f"WITH e AS MATERIALIZED ({LINKS}), " + ", ".join(steps)


ROUNDS = 12
PATHS = f"""{rounds_sql(ROUNDS)}, p AS (SELECT v.id, v.dist, min(e.src) AS pred FROM d{ROUNDS} v JOIN e ON e.dst = v.id JOIN d{ROUNDS} u ON u.id = e.src AND u.dist + e.weight = v.dist GROUP BY 1, 2)"""


def path_tree(t: Tables):
    start = source_host(t).first()["source"]
    rows = t.sql("SELECT l_orderkey AS block_no, l_suppkey AS host FROM @lineitem")  # the edges take each placement once
    edges = G.cooccurrence_edges(rows, "block_no", "host", t("order_labels"))
    return start, G.shortest_paths(edges.select("src", "dst", "weight"), start)


@query("h4_shortest_paths", f"{PATHS} SELECT v.id, round(v.dist, 9) AS dist, coalesce(p.pred, -1) AS pred FROM d{ROUNDS} v LEFT JOIN p USING (id)")
def _(t):
    _start, tree = path_tree(t)
    return tree.select("id", F.round("dist", 9).alias("dist"), F.coalesce("pred", F.lit(-1)).alias("pred"))


@query("h5_path_to", PATHS.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, w(id, path, hops) AS (SELECT id, CAST(id AS VARCHAR), 0 FROM d0
    UNION ALL SELECT p.id, w.path || '>' || CAST(p.id AS VARCHAR), w.hops + 1 FROM w JOIN p ON p.pred = w.id) SELECT id, path, hops FROM w""")
def _(t):
    start, tree = path_tree(t)
    paths = G.path_to(tree, start)
    return paths.select("id", F.concat_ws(">", F.transform("path", lambda v: v.cast("string"))).alias("path"), (F.size("path") - 1).alias("hops"))


TRANSFER_PAIRS = """SELECT DISTINCT arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS src, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey)) AS dst
    FROM @lineitem GROUP BY l_orderkey"""


def transfer_pairs(t: Tables):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return t("lineitem").groupBy("l_orderkey").agg(
        F.min_by("l_suppkey", order).alias("src"), F.max_by("l_suppkey", order).alias("dst")).select("src", "dst").distinct()


@query("h6_bounded_shortest_path", f"""WITH RECURSIVE e AS MATERIALIZED ({LINKS}), q AS MATERIALIZED ({TRANSFER_PAIRS}), c(source, id, hops) AS (SELECT DISTINCT src, src, 0 FROM q
    UNION SELECT c.source, e.dst, c.hops + 1 FROM c JOIN e ON e.src = c.id WHERE c.hops < 4)
    SELECT q.src, q.dst, min(hops) AS hops FROM q JOIN c ON c.source = q.src AND c.id = q.dst GROUP BY 1, 2""")
def _(t):
    return G.bounded_shortest_path(host_edges(t), transfer_pairs(t), 4)


HOSTS = f"SELECT src_ip AS ip FROM ({TRANSFERS}) UNION SELECT dst_ip FROM ({TRANSFERS}) UNION SELECT host_ip FROM ({REPLICAS})"
CO_REPLICA = f"SELECT a.host_ip AS src, b.host_ip AS dst, count(*) AS n FROM ({REPLICAS}) a JOIN ({REPLICAS}) b ON a.block_id = b.block_id AND a.host_ip < b.host_ip GROUP BY 1, 2"


def log_graph(t: Tables):
    """Link tables of the log and their co-replica edges; the narrow extract is written once."""
    links = durable(P.extract_links(parse_log(t("log_raw")), "content", "event_id", "block_id"))
    tables = P.link_tables(links)
    return tables | {"edges": G.cooccurrence_edges(tables["stored"], "block_id", "host_ip")}


@query("h7_graph_stats", f"""WITH h AS ({HOSTS}), e AS ({CO_REPLICA}), t AS ({TRANSFERS}), r AS ({REREPL})
    SELECT (SELECT count(*) FROM h) AS vertices, (SELECT count(DISTINCT split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2)) FROM h) AS subnets,
    (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM t WHERE src_ip = dst_ip) AS self_loops, (SELECT count(*) FROM r) AS rereplications,
    (SELECT count(*) FROM r WHERE split_part(src_ip, '.', 2) <> split_part(dst_ip, '.', 2)) AS cross_subnet,
    round(2 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM h) * ((SELECT count(*) FROM h) - 1)), 6) AS density""")
def _(t):
    g = log_graph(t)
    return G.graph_stats(g["hosts"], g["edges"], g["transfers"], g["moves"]).withColumn("density", F.round("density", 6))


@query("a32_graph_counts", f"""SELECT (SELECT count(*) FROM ({HOSTS})) AS hosts, (SELECT count(*) FROM ({CO_REPLICA})) AS co_replica_edges,
    (SELECT count(DISTINCT {KEY}) FROM @log_raw) AS blocks""")
def _(t):
    g = log_graph(t)
    return one_row([
        g["hosts"].agg(F.count(F.lit(1)).alias("hosts")), g["edges"].agg(F.count(F.lit(1)).alias("co_replica_edges")),
        g["blocks"].agg(F.count(F.lit(1)).alias("blocks"))])


GRAPH_NODES = f"""SELECT 'Host' AS kind, ip AS id FROM ({HOSTS}) UNION SELECT 'Subnet', split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.0.0/16' FROM ({HOSTS})
    UNION SELECT 'Block', {KEY} FROM @log_raw WHERE {KEY} IS NOT NULL UNION SELECT 'IP', src_ip FROM @flows UNION SELECT 'IP', dest_ip FROM @flows
    UNION SELECT 'IP', src_ip FROM @alerts UNION SELECT 'Signature', CAST(signature_id AS VARCHAR) FROM @alerts UNION SELECT 'Rack', rack FROM ({HARDWARE}) WHERE rack IS NOT NULL
    UNION SELECT 'Midplane', rack || '-' || midplane FROM ({HARDWARE}) WHERE rack IS NOT NULL UNION SELECT 'ComputeNode', node FROM ({HARDWARE}) WHERE rack IS NOT NULL"""


@query("s11_property_graph_nodes", GRAPH_NODES)
def _(t):
    g = log_graph(t)
    nodes = parse_hardware_log(t("hardware_raw")).filter(F.col("rack").isNotNull())
    ips = R.union_distinct(t("flows").select(F.col("src_ip").alias("ip")), t("flows").select("dest_ip"), t("alerts").select("src_ip"))
    return G.property_graph_nodes({
        "Host": (g["hosts"], "ip"),
        "Subnet": (g["hosts"].select(P.subnet16(F.col("ip")).alias("cidr")), "cidr"),
        "Block": (g["blocks"], "block_id"), "IP": (ips, "ip"),
        "Signature": (t("alerts"), "signature_id"), "Rack": (nodes, "rack"),
        "Midplane": (nodes.select(F.concat_ws("-", "rack", "midplane").alias("id")), "id"), "ComputeNode": (nodes, "node"),
    })


GRAPH_EDGES = f"""SELECT type, src, dst, count(*) AS n FROM (SELECT 'IN_SUBNET' AS type, ip AS src, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.0.0/16' AS dst FROM ({HOSTS})
    UNION ALL SELECT 'STORED_ON', block_id, host_ip FROM ({REPLICAS}) UNION ALL SELECT 'RECEIVED_BY', block_id, dst_ip FROM ({TRANSFERS})
    UNION ALL SELECT 'REREPLICATED', src_ip, dst_ip FROM ({REREPL}) UNION ALL SELECT 'CO_REPLICA', src, dst FROM ({CO_REPLICA})
    UNION ALL SELECT 'FLOW', src_ip, dest_ip FROM @flows UNION ALL SELECT 'TRIGGERED', src_ip, CAST(signature_id AS VARCHAR) FROM @alerts
    UNION ALL SELECT 'HAS_MIDPLANE', rack, rack || '-' || midplane FROM ({HARDWARE}) WHERE rack IS NOT NULL
    UNION ALL SELECT 'HAS_NODE', rack || '-' || midplane, node FROM ({HARDWARE}) WHERE rack IS NOT NULL) GROUP BY 1, 2, 3"""


@query("s11_property_graph_edges", GRAPH_EDGES)
def _(t):
    g = log_graph(t)
    nodes = parse_hardware_log(t("hardware_raw")).filter(F.col("rack").isNotNull()).select(
        "node", "rack", F.concat_ws("-", "rack", "midplane").alias("mid"))
    return G.property_graph_edges({
        "IN_SUBNET": (g["hosts"].select("ip", P.subnet16(F.col("ip")).alias("cidr")), "ip", "cidr"),
        "STORED_ON": (g["stored"], "block_id", "host_ip"), "RECEIVED_BY": (g["transfers"], "block_id", "dst_ip"),
        "REREPLICATED": (g["moves"], "src_ip", "dst_ip"), "CO_REPLICA": (g["edges"], "src", "dst"),
        "FLOW": (t("flows"), "src_ip", "dest_ip"), "TRIGGERED": (t("alerts"), "src_ip", "signature_id"),
        "HAS_MIDPLANE": (nodes, "rack", "mid"), "HAS_NODE": (nodes, "mid", "node"),
    })


NODE_PROPERTIES = f"""SELECT 'Block' AS kind, block_id AS id, 'is_anomaly=' || CAST(is_anomaly AS VARCHAR) || ';pca_flag=' || CAST(flag AS VARCHAR)
      || ';pca_residual_e4=' || CAST(CAST(floor(residual * 10000) AS BIGINT) AS VARCHAR) || ';split=' || split AS properties FROM ({SPLIT})
    UNION ALL SELECT 'Signature', CAST(signature_id AS VARCHAR), 'category=' || min(category) || ';name=' || min(signature) FROM @alerts GROUP BY signature_id
    UNION ALL SELECT 'ComputeNode', node, 'alert_types=' || alert_types || ';alerts=' || CAST(alerts AS VARCHAR) || ';lines=' || CAST(lines AS VARCHAR) FROM ({NODES})
    UNION ALL SELECT 'Host', ip, '' FROM ({HOSTS})
    UNION ALL SELECT 'IP', ip, '' FROM (SELECT src_ip AS ip FROM @flows UNION SELECT dest_ip FROM @flows UNION SELECT src_ip FROM @alerts)"""


@query("s11_node_properties", NODE_PROPERTIES)
def _(t):
    blocks = split_blocks(t)
    residual = {"pca_residual_e4": F.floor(F.col("residual") * 10000), "pca_flag": F.col("flag")}
    outcome = {"is_anomaly": F.col("is_anomaly"), "split": F.col("split")}
    signatures = t("alerts").groupBy("signature_id").agg(F.min("signature").alias("name"), F.min("category").alias("category"))
    nodes = R.node_alert_rollup(parse_hardware_log(t("hardware_raw")))
    writes = [
        G.node_writes(blocks, "Block", "block_id", {"split": F.lit("unknown")} | residual, F.lit(0)),
        G.node_writes(blocks, "Block", "block_id", outcome, F.lit(1)),
        G.node_writes(signatures, "Signature", "signature_id", {"name": F.col("name"), "category": F.col("category")}),
        G.node_writes(nodes, "ComputeNode", "node", {c: F.col(c) for c in ("lines", "alerts", "alert_types")}),
        G.node_writes(log_graph(t)["hosts"], "Host", "ip"),
        *[G.node_writes(t(name).select(F.col(c).alias("ip")).distinct(), "IP", "ip")
          for name, c in (("flows", "src_ip"), ("flows", "dest_ip"), ("alerts", "src_ip"))],
    ]
    nodes = G.merged(reduce(DataFrame.unionByName, writes))
    return nodes.select("kind", "id", G.properties_text(F.col("properties")).alias("properties"))


EDGE_PROPERTIES = f"""SELECT 'FLOW' AS type, src_ip AS src, dest_ip AS dst, 'port=' || coalesce(CAST(dest_port AS VARCHAR), '') || ';proto=' || coalesce(proto, '') AS key,
      'alerted_flows=' || CAST(count(*) FILTER (WHERE alerted) AS VARCHAR) || coalesce(';bytes=' || CAST(CAST(sum(bytes_toserver) AS BIGINT) AS VARCHAR), '')
      || ';flows=' || CAST(count(*) AS VARCHAR) || coalesce(';pkts=' || CAST(CAST(sum(pkts_toserver) AS BIGINT) AS VARCHAR), '') AS properties
      FROM @flows WHERE src_ip IS NOT NULL AND dest_ip IS NOT NULL GROUP BY src_ip, dest_ip, dest_port, proto
    UNION ALL SELECT 'TRIGGERED', src_ip, CAST(signature_id AS VARCHAR), '', 'hits=' || CAST(count(*) AS VARCHAR) FROM @alerts GROUP BY src_ip, signature_id
    UNION ALL SELECT DISTINCT 'REREPLICATED', src_ip, dst_ip, 'block=' || coalesce(block_id, ''), '' FROM ({REREPL}) WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL
    UNION ALL SELECT 'CO_REPLICA', a.host_ip, b.host_ip, '', 'anomalous=' || CAST(count(*) FILTER (WHERE coalesce(y, false)) AS VARCHAR)
      || ';blocks=' || CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT block_id, host_ip FROM ({REPLICAS})) a
      JOIN (SELECT DISTINCT block_id, host_ip FROM ({REPLICAS})) b ON a.block_id = b.block_id AND a.host_ip < b.host_ip
      LEFT JOIN (SELECT BlockId, bool_or(Label = 'Anomaly') AS y FROM @label_raw GROUP BY 1) l ON l.BlockId = a.block_id GROUP BY 2, 3"""


@query("s11_edge_properties", EDGE_PROPERTIES)
def _(t):
    g = log_graph(t)
    bad = t("label_raw").groupBy(F.col("BlockId").alias("block_id")).agg(F.bool_or(F.col("Label") == "Anomaly").alias("_y"))
    labels = g["stored"].select("block_id").distinct().join(bad, "block_id", "left").select(
        "block_id", F.coalesce("_y", F.lit(False)).alias("is_anomaly"))
    peers = G.cooccurrence_edges(g["stored"], "block_id", "host_ip", labels)
    writes = [
        G.edge_writes(R.flow_edges(t("flows")), "FLOW", "src_ip", "dest_ip", {"port": F.col("dest_port"), "proto": F.col("proto")},
                      {c: F.col(c) for c in ("flows", "alerted_flows", "pkts", "bytes")}),
        G.edge_writes(R.alert_edges(t("alerts")), "TRIGGERED", "src_ip", "signature_id", None, {"hits": F.col("hits")}),
        G.edge_writes(g["moves"], "REREPLICATED", "src_ip", "dst_ip", {"block": F.col("block_id")}),
        G.edge_writes(peers, "CO_REPLICA", "src", "dst", None, {"blocks": F.col("n"), "anomalous": F.col("n_pos")}),
    ]
    edges = G.merged(reduce(DataFrame.unionByName, writes))
    return edges.select("type", "src", "dst", "key", G.properties_text(F.col("properties")).alias("properties"))
