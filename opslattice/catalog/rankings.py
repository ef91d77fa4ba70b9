"""Windows, top-k, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslattice.catalog.aggregates import FAN_OUT, PORTS, external_flows
from opslattice.catalog.base import Tables, query
from opslattice.catalog.joins import PAIRS, SPLIT, split_blocks
from opslattice.catalog.parsing import REPLICAS, TRANSFERS, flow_records
from opslattice.functions import parsing as P
from opslattice.operators import audit, detection, evaluation, graph, metrics
from opslattice.operators import relational as R
from opslattice.operators.sessions import parse_log
from opslattice.operators.timeseries import gap_to_previous
from opslattice.plans.runtime import durable
from opslattice.plans.skew import history, split_bursts


@query("w1_gap_to_previous", """SELECT event_id AS id, coalesce(lag(event_id) OVER w, -1) AS prev_id,
    coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w), -1) AS gap_us FROM @events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def _(t):
    gaps = gap_to_previous(t("events"), "user_id", "ts", "event_id")
    return gaps.select("id", F.coalesce("prev_id", F.lit(-1)).alias("prev_id"), F.coalesce("gap_us", F.lit(-1)).alias("gap_us"))


SEQUENCE = """SELECT event_id AS line, event_type AS template, CAST(user_id * 100 + day(ts) AS BIGINT) AS session, CAST(hour(ts) AS INT) AS cell, ts FROM @events"""


def sequences(t: Tables):
    return t.sql(SEQUENCE)


@query("w2_history_window", f"""SELECT line, array_to_string(list_concat(list_resize(CAST([] AS VARCHAR[]), CAST(10 - len(h) AS BIGINT), '0'), h), ',') AS history FROM (
    SELECT line, coalesce(list(template) OVER (PARTITION BY session ORDER BY ts, line ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), CAST([] AS VARCHAR[])) AS h FROM ({SEQUENCE}))""")
def _(t):
    padded = detection.padded_history(sequences(t), "session", "cell", ["ts", "line"], "template", 10)
    return padded.select("line", F.concat_ws(",", "history").alias("history"))


@query("w3_chrono_split", f"SELECT block_no, split FROM ({SPLIT})")
def _(t):
    return split_blocks(t).select("block_no", "split")


@query("w4_half_split", """SELECT i, CASE WHEN row_number() OVER (ORDER BY i) % 2 = 1 THEN 'A' ELSE 'B' END AS half FROM @prompts""")
def _(t):
    return evaluation.half_split(t("prompts"), "i").select("i", "half")


@query("w5_cumulative_confusion", """SELECT score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM
    (SELECT l_extendedprice AS score, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM @lineitem GROUP BY 1)""")
def _(t):
    rows = t("lineitem").select((F.col("l_returnflag") == "R").alias("y"), F.col("l_extendedprice").alias("s"))
    return metrics.score_steps(rows, "y", "s").select("score", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


@query("w6_top_per_key", """SELECT src_ip, signature, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, signature) AS rank
    FROM (SELECT src_ip, signature, count(*) AS n FROM @alerts GROUP BY 1, 2)) WHERE rank <= 3""")
def _(t):
    counts = t("alerts").groupBy("src_ip", "signature").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_key(counts, "src_ip", [F.desc("n"), F.asc("signature")], 3)


CONTEXTS = f"""SELECT len, ctx, template AS next, count(*) AS cnt FROM (
    SELECT template, unnest([0, 1, 2, 3]) AS len, unnest(['0|', CASE WHEN p1 IS NOT NULL THEN '1|' || p1 END,
      CASE WHEN p2 IS NOT NULL THEN '2|' || p2 || ',' || p1 END, CASE WHEN p3 IS NOT NULL THEN '3|' || p3 || ',' || p2 || ',' || p1 END]) AS ctx
    FROM (SELECT template, session, lag(template, 1) OVER w AS p1, lag(template, 2) OVER w AS p2, lag(template, 3) OVER w AS p3
      FROM ({SEQUENCE}) WINDOW w AS (PARTITION BY session ORDER BY ts, line))
    WHERE session % 3 <> 0) WHERE ctx IS NOT NULL GROUP BY 1, 2, 3"""


@query("w7_rank_of_true_event", f"""SELECT ctx, next, cnt, rank() OVER (PARTITION BY ctx ORDER BY cnt DESC) - 1 AS rank,
    round(cnt / sum(cnt) OVER (PARTITION BY ctx), 6) AS p FROM ({CONTEXTS})""")
def _(t):
    listed = history(split_bursts(sequences(t), ["session"], "cell", ["ts", "line"]), ["session"], "cell", ["ts", "line"], "template", 3)
    model = detection.context_model(listed.filter("session % 3 <> 0"), "history", "template", [3, 2, 1, 0])
    return model.select("ctx", "next", "cnt", F.col("rank").cast("bigint").alias("rank"), F.round("p", 6).alias("p"))


@query("k1_top_k", "SELECT l_orderkey, l_partkey, l_extendedprice FROM @lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 7")
def _(t):
    return R.top_k(t("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice"), 7,
                   [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey")])


SCANNERS = f"SELECT src_ip, ports, dests, flows FROM ({FAN_OUT}) ORDER BY ports DESC, flows DESC, src_ip LIMIT 5"


def top_scanners(t: Tables):
    return R.top_k(R.fan_out(external_flows(t)), 5, [F.desc("ports"), F.desc("flows"), F.asc("src_ip")])


@query("k2_top_scanners", SCANNERS)
def _(t):
    return top_scanners(t)


@query("k3_top_signatures", """SELECT signature_id, min(signature) AS signature, count(DISTINCT src_ip) AS sources, count(*) AS hits FROM @alerts
    GROUP BY 1 ORDER BY hits DESC, signature_id LIMIT 5""")
def _(t):
    per = R.alert_edges(t("alerts")).groupBy("signature_id").agg(
        F.min("signature").alias("signature"), F.count(F.lit(1)).alias("sources"), F.sum("hits").alias("hits"))
    return R.top_k(per, 5, [F.desc("hits"), F.asc("signature_id")])


@query("k4_top_ports", f"SELECT * FROM ({PORTS}) ORDER BY sources DESC, flows DESC, port, proto LIMIT 15")
def _(t):
    return audit.top_ports(audit.port_accept_reject(P.inbound_unsolicited(flow_records(t))))


HOTSPOT = """SELECT host FROM (SELECT host, count(*) AS n, avg(CAST(is_anomaly AS INT)) AS rate FROM @placement JOIN @order_labels USING (block_no)
    GROUP BY 1 HAVING count(*) >= 20) ORDER BY rate DESC, n DESC, host LIMIT 1"""


def hotspot_pick(t: Tables):
    per = t("placement").join(t("order_labels"), "block_no").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_anomaly").cast("int")).alias("rate"))
    return R.top_k(per.filter("n >= 20"), 1, [F.desc("rate"), F.desc("n"), F.asc("host")]).select("host")


@query("k5_hotspot_pick", HOTSPOT)
def _(t):
    return hotspot_pick(t)


@query("k6_hotspot_peers", f"""WITH h AS ({HOTSPOT}), e AS ({PAIRS}), s AS (SELECT src, dst, n, n_pos FROM e UNION ALL SELECT dst, src, n, n_pos FROM e)
    SELECT dst AS peer, n AS shared, n_pos AS shared_anomalous FROM s JOIN h ON src = host ORDER BY n_pos DESC, n DESC, dst LIMIT 5""")
def _(t):
    host = hotspot_pick(t).select(F.col("host").alias("id"))
    return graph.hotspot_peers(graph.peers_of(t("placement"), "block_no", "host", host, t("order_labels")))


@query("k7_weighted_degree_top", f"""WITH e AS ({PAIRS}) SELECT src AS id, CAST(sum(n) AS BIGINT) AS degree, count(*) AS peers FROM
    (SELECT src, n FROM e UNION ALL SELECT dst, n FROM e) GROUP BY 1 ORDER BY degree DESC, id LIMIT 5""")
def _(t):
    order = [F.desc("degree"), F.asc("id")]
    placed = t("placement").join(t("order_labels").select("block_no"), "block_no", "left_semi")
    top = durable(R.top_k(graph.weighted_degree(placed, "block_no", "host"), 5, order))
    peers = graph.peers_of(placed, "block_no", "host", top).groupBy("id").agg(F.count(F.lit(1)).alias("peers"))
    return R.top_k(top.join(peers, "id"), 5, order).select("id", "degree", "peers")


@query("k9_ordered_export", "SELECT o_orderkey, o_orderdate, o_totalprice FROM @orders ORDER BY o_orderdate, o_orderkey")
def _(t):
    return t("orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy("o_orderdate", "o_orderkey")


@query("u1_union_distinct_hosts", f"SELECT src_ip AS ip FROM ({TRANSFERS}) UNION SELECT dst_ip FROM ({TRANSFERS}) UNION SELECT host_ip FROM ({REPLICAS})")
def _(t):
    return all_hosts(t)


def all_hosts(t: Tables):
    log = parse_log(t("log_raw"))
    moves, stored = P.extract_transfers(log, "content", "block_id"), P.extract_placement(log, "content")
    return R.union_distinct(*[df.select(F.col(c).alias("ip")) for df, c in ((moves, "src_ip"), (moves, "dst_ip"), (stored, "host_ip"))])


TOUCHES = f"""SELECT src_ip AS ip, block_id FROM ({TRANSFERS}) UNION SELECT dst_ip, block_id FROM ({TRANSFERS})
    UNION SELECT host_ip, block_id FROM ({REPLICAS})"""


def touches(t: Tables):
    log = parse_log(t("log_raw"))
    moves, stored = P.extract_transfers(log, "content", "block_id"), P.extract_placement(log, "content")
    return R.union_distinct(*[df.select(F.col(c).alias("ip"), "block_id")
                              for df, c in ((moves, "src_ip"), (moves, "dst_ip"), (stored, "host_ip"))])


@query("u2_union_distinct_touches", TOUCHES)
def _(t):
    return touches(t)


@query("u3_set_algebra", """SELECT o_orderkey, len(list_intersect(a, b)) AS common, len(list_intersect(a, b)) = len(a) AS subset,
    len(list_intersect(a, b)) = len(a) AND len(a) = len(b) AS equal FROM (SELECT l_orderkey AS o_orderkey,
      coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R'), []) AS a, coalesce(list(DISTINCT l_suppkey) FILTER (WHERE l_linestatus = 'O'), []) AS b
      FROM @lineitem GROUP BY 1)""")
def _(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", (F.col("l_returnflag") == "R").alias("a"),
                                (F.col("l_linestatus") == "O").alias("b"))
    return R.set_algebra(rows, "o_orderkey", "l_suppkey", "a", "b")


@query("u4_partition_equality", """WITH a AS (SELECT c_custkey AS m, min(c_custkey) OVER (PARTITION BY c_nationkey) AS g FROM @customer),
    b AS (SELECT c_custkey AS m, min(c_custkey) OVER (PARTITION BY c_nationkey % 20) AS g FROM @customer)
    SELECT a.m AS c_custkey, a.g AS left_group, b.g AS right_group FROM a JOIN b USING (m) WHERE a.g <> b.g""")
def _(t):
    people = t("customer").select("c_custkey", F.col("c_nationkey").alias("g"))
    other = people.withColumn("g", F.col("g") % 20)
    return R.partition_difference(people, other, "c_custkey", "g")
