"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslattice.catalog.base import Tables, query
from opslattice.catalog.parsing import HARDWARE, KEY, PORT_RANGE, REPUTATION, rules
from opslattice.functions import parsing as P
from opslattice.operators import relational as R
from opslattice.operators.audit import audit_public_ips, audit_unattached, exposed_rules
from opslattice.operators.detection import key_rate
from opslattice.operators.graph import cooccurrence_edges
from opslattice.operators.metrics import chrono_split
from opslattice.operators.sessions import count_long, parse_hardware_log, parse_log, sequence_signature, session_rollup
from opslattice.operators.timeseries import partners_in_window

LOG = f"SELECT CAST(LineId AS INT) AS line_id, EventId AS event_id, {KEY} AS block_id FROM @log_raw WHERE {KEY} IS NOT NULL"


def keyed_log(t: Tables):
    return P.drop_unkeyed(parse_log(t("log_raw")), "block_id")


def labels(t: Tables):
    return t("label_raw").select(F.col("BlockId").alias("block_id"), F.col("Label").alias("label"))


def log_sessions(t: Tables):
    return session_rollup(keyed_log(t), "block_id", "ts", "event_id", labels(t))


@query("j1_events_labels", f"""SELECT block_id, Label = 'Anomaly' AS is_anomaly, count(*) AS lines FROM ({LOG})
    JOIN @label_raw ON BlockId = block_id GROUP BY 1, 2""")
def _(t):
    per = keyed_log(t).groupBy("block_id").agg(F.count(F.lit(1)).alias("lines"))
    return per.join(labels(t), "block_id").select("block_id", (F.col("label") == "Anomaly").alias("is_anomaly"), "lines")


@query("j2_orphan_anti_join", f"""SELECT line_id, block_id FROM ({LOG}) e LEFT JOIN @label_raw l ON l.BlockId = e.block_id WHERE l.BlockId IS NULL""")
def _(t):
    return R.orphans(keyed_log(t).select("line_id", "block_id"), labels(t), "block_id")


@query("j3_using_join", """SELECT block_no, is_anomaly, event_id, count(*) AS cnt FROM @block_lines JOIN
    (SELECT block_no, is_anomaly FROM @blocks) b USING (block_no) GROUP BY 1, 2, 3""")
def _(t):
    per = t("block_lines").groupBy("block_no", "event_id").agg(F.count(F.lit(1)).alias("cnt"))
    return per.join(t("blocks").select("block_no", "is_anomaly"), "block_no")


PAIRS = """SELECT a.host AS src, b.host AS dst, count(*) AS n, count(*) FILTER (WHERE l.is_anomaly) AS n_pos
    FROM @placement a JOIN @placement b ON a.block_no = b.block_no AND a.host < b.host
    JOIN @order_labels l ON l.block_no = a.block_no GROUP BY 1, 2"""


@query("j4_cooccurrence_self_join", PAIRS)
def _(t):
    return cooccurrence_edges(t("placement"), "block_no", "host", t("order_labels")).drop("weight")


@query("j5_full_outer", """SELECT coalesce(f.src_ip, a.src_ip) AS src_ip, coalesce(flows, 0) AS flows, coalesce(alerts, 0) AS alerts FROM
    (SELECT src_ip, count(*) AS flows FROM @flows GROUP BY 1) f FULL JOIN
    (SELECT src_ip, count(*) AS alerts FROM @alerts GROUP BY 1) a ON f.src_ip = a.src_ip""")
def _(t):
    flows = t("flows").groupBy("src_ip").agg(F.count(F.lit(1)).alias("flows"))
    alerts = t("alerts").groupBy("src_ip").agg(F.count(F.lit(1)).alias("alerts"))
    return R.full_outer_filled(flows, alerts, "src_ip", ["flows", "alerts"])


@query("j6_left_join_category", """SELECT f.flow_id, coalesce(a.category, 'no linked alert record') AS category FROM @flows f LEFT JOIN
    (SELECT flow_id, min(category) AS category FROM @alerts GROUP BY 1) a ON f.flow_id = a.flow_id WHERE f.alerted""")
def _(t):
    category = t("alerts").groupBy("flow_id").agg(F.min("category").alias("category"))
    return R.dictionary_lookup(t("flows").filter("alerted").select("flow_id"), category, "flow_id", "category",
                               F.lit("no linked alert record"))


@query("j7_semi_join", """SELECT flow_id, src_ip FROM @flows WHERE flow_id IN (SELECT flow_id FROM @alerts WHERE severity = 1)""")
def _(t):
    return t("flows").select("flow_id", "src_ip").join(
        t("alerts").filter("severity = 1").select("flow_id"), "flow_id", "left_semi")


@query("j8_not_in", """SELECT DISTINCT src_ip FROM @flows WHERE src_ip NOT IN (SELECT src_ip FROM @alerts)""")
def _(t):
    return R.not_in(t("flows").select("src_ip").distinct(), t("alerts"), "src_ip")


@query("j9_dictionary_lookup", """SELECT block_no, coalesce(priority, 'none') AS priority, count(*) AS lines FROM @block_lines LEFT JOIN
    (SELECT o_orderkey, o_orderpriority AS priority FROM @orders) o ON block_no = o_orderkey GROUP BY 1, 2""")
def _(t):
    per = t("block_lines").groupBy("block_no").agg(F.count(F.lit(1)).alias("lines"))
    table = t("orders").select(
        F.col("o_orderkey").alias("block_no"), F.col("o_orderpriority").alias("priority"))
    return R.dictionary_lookup(per, table, "block_no", "priority", F.lit("none"))


@query("j10_scored_replicas", """SELECT p.block_no, p.host, s.flag FROM @placement p JOIN
    (SELECT block_no, flag FROM @blocks) s ON s.block_no = p.block_no""")
def _(t):
    scored = t("blocks").select("block_no", "flag")
    return t("placement").join(scored, "block_no")


PROBED = """SELECT dest_port, count(*) AS flows, count(*) FILTER (WHERE alerted) AS alerted, count(DISTINCT src_ip) AS sources
    FROM @flows WHERE NOT (src_ip LIKE '192.168.%' OR src_ip LIKE '10.%' OR src_ip LIKE '172.16.%') GROUP BY 1"""


def probed(t: Tables):
    return R.probed_ports(t("flows").filter(P.is_external_prefix(F.col("src_ip"))))


@query("j11_port_in_range", f"""SELECT sg_id, lo, hi, dest_port, alerted FROM ({PORT_RANGE}) r JOIN ({PROBED}) p
    ON p.dest_port BETWEEN r.lo AND r.hi AND p.alerted > 0 WHERE r.cidr IN ('0.0.0.0/0', '::/0')""")
def _(t):
    hits = R.range_join(exposed_rules(rules(t)), probed(t).filter("alerted > 0"), "lo", "hi", "dest_port")
    return hits.select("sg_id", "lo", "hi", "dest_port", "alerted")


UNNEEDED = """SELECT region, CAST(eni AS VARCHAR) AS eni, type FROM @interfaces i LEFT JOIN
    (SELECT sg_id AS open_id FROM @sg_rules WHERE cidr IN ('0.0.0.0/0', '::/0')) o ON i.sg_id = o.open_id
    WHERE public_ip GROUP BY 1, 2, 3 HAVING count(open_id) = 0"""


@query("j12_no_overlap", UNNEEDED)
def _(t):
    return audit_public_ips(rules(t), t("interfaces")).select("region", "eni", "type")


UNATTACHED = """SELECT region, name || ' (' || CAST(sg_id AS VARCHAR) || ')' AS sg FROM @sg_groups WHERE name <> 'default'
    AND sg_id NOT IN (SELECT sg_id FROM @interfaces WHERE sg_id IS NOT NULL)"""


@query("j13_unattached_anti_join", UNATTACHED)
def _(t):
    return audit_unattached(t("sg_groups"), t("interfaces")).select("region", "sg")


@query("j14_links_in_window", """SELECT a.event_id AS id, count(b.event_id) AS partners FROM @events a LEFT JOIN @events b
    ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL '1800' SECOND AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))
    GROUP BY 1""")
def _(t):
    return partners_in_window(t("events"), "user_id", "ts", "event_id", 1800)


SIGNATURES = """SELECT block_id, block_no, string_agg(event_id || 'x' || CAST(cnt AS VARCHAR), ' ' ORDER BY event_id) AS seq FROM
    (SELECT block_id, block_no, event_id, count(*) AS cnt FROM @block_lines GROUP BY 1, 2, 3) GROUP BY 1, 2"""
SPLIT = """SELECT *, CASE WHEN row_number() OVER (ORDER BY first_ts, block_no) <= CAST(floor(0.7 * count(*) OVER ()) AS BIGINT)
    THEN 'train' ELSE 'test' END AS split FROM @blocks"""


def signatures(t: Tables):
    return sequence_signature(count_long(t("block_lines"), "block_id", "event_id"), "block_id", "event_id")


def split_blocks(t: Tables):
    """Blocks with their split; the cut is searched once per query."""
    return t.once("split_blocks", lambda: chrono_split(t("blocks"), "first_ts", "block_no"))


@query("j15_exact_sequence_history", f"""WITH s AS ({SIGNATURES}), p AS ({SPLIT}), h AS (
    SELECT seq, count(*) FILTER (WHERE is_anomaly) AS past_anomalous, count(*) FILTER (WHERE NOT is_anomaly) AS past_normal
    FROM s JOIN p USING (block_id) WHERE split = 'train' GROUP BY 1)
    SELECT s.block_id, coalesce(past_anomalous, 0) AS past_anomalous, coalesce(past_normal, 0) AS past_normal, h.seq IS NOT NULL AS exact
    FROM s JOIN p USING (block_id) LEFT JOIN h ON h.seq = s.seq WHERE split = 'test'""")
def _(t):
    from opslattice.operators.retrieval import sequence_history

    rows = signatures(t).join(split_blocks(t).select("block_id", "split", "is_anomaly"), "block_id")
    past = sequence_history(rows.filter("split = 'train'"))
    return rows.filter("split = 'test'").join(past, "seq", "left").select(
        "block_id", F.coalesce("past_anomalous", F.lit(0)).alias("past_anomalous"),
        F.coalesce("past_normal", F.lit(0)).alias("past_normal"), F.col("past_normal").isNotNull().alias("exact"))


@query("j16_hierarchy_path", """SELECT r_name AS rack, n_name AS midplane, count(*) AS nodes, CAST(sum(lines) AS BIGINT) AS alerts FROM @region
    JOIN @nation ON n_regionkey = r_regionkey JOIN @supplier ON s_nationkey = n_nationkey
    JOIN (SELECT l_suppkey, count(*) AS lines FROM @lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def _(t):
    lines = t("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("lines"))
    nodes = lines.join(t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), "s_suppkey")
    paths = nodes.join(t("nation"), "n_nationkey").join(
        t("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return paths.groupBy(F.col("r_name").alias("rack"), F.col("n_name").alias("midplane")).agg(
        F.count(F.lit(1)).alias("nodes"), F.sum("lines").alias("alerts"))


TOUCH = """SELECT l_suppkey AS host, l_orderkey AS block_no FROM @lineitem UNION
    SELECT s_suppkey, o_orderkey FROM @orders JOIN @supplier ON s_suppkey = o_custkey"""


def received(t: Tables):
    return t("orders").select(F.col("o_custkey").alias("host"), F.col("o_orderkey").alias("block_no")).join(
        t("supplier").select(F.col("s_suppkey").alias("host")), "host", "left_semi")


@query("j17_multi_relation_match", f"""SELECT host, count(*) AS blocks, count(*) FILTER (WHERE is_anomaly) AS anomalous,
    round(count(*) FILTER (WHERE is_anomaly) / count(*), 6) AS rate FROM ({TOUCH}) t JOIN @order_labels USING (block_no)
    GROUP BY 1 HAVING count(*) >= 20""")
def _(t):
    touch = R.union_distinct(t("placement").select("host", "block_no"), received(t).select("host", "block_no"))
    per = touch.join(t("order_labels"), "block_no").groupBy("host").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if("is_anomaly").alias("anomalous"))
    return per.filter("blocks >= 20").withColumn("rate", F.round(F.col("anomalous") / F.col("blocks"), 6))


@query("j18_result_parity", """WITH a AS (SELECT user_id, count(*) AS n FROM @events GROUP BY 1),
    b AS (SELECT user_id, count(*) AS n FROM @events WHERE event_type <> 'signup' GROUP BY 1)
    SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL
    SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(t):
    count = F.count(F.lit(1)).alias("n")
    a = t("events").groupBy("user_id").agg(count)
    b = t("events").filter("event_type <> 'signup'").groupBy("user_id").agg(count)
    return R.result_difference(a, b)


@query("j19_flow_alert_link", f"""SELECT f.flow_id, a.category, f.flow_id IN (SELECT flow_id FROM @alerts WHERE {REPUTATION}) AS reputation
    FROM @flows f JOIN (SELECT flow_id, min(category) AS category FROM @alerts GROUP BY 1) a ON f.flow_id = a.flow_id""")
def _(t):
    per = t("alerts").groupBy("flow_id").agg(
        F.min("category").alias("category"), F.max(P.is_reputation_signature(F.col("signature"))).alias("reputation"))
    return t("flows").select("flow_id").join(per, "flow_id")
