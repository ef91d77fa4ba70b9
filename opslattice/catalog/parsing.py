"""Projections, filters, predicates and scalar families."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslattice.catalog.base import Tables, query
from opslattice.functions import parsing as P
from opslattice.operators.sessions import parse_hardware_log, parse_log

KEY = r"nullif(regexp_extract(Content, '(blk_-?[0-9]+)', 1), '')"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


@query("p1_extract_key", f"SELECT CAST(LineId AS INT) AS line_id, {KEY} AS block_id FROM @log_raw")
def _(t: Tables):
    return parse_log(t("log_raw")).select("line_id", "block_id")


@query("p2_compose_ts", """SELECT CAST(LineId AS INT) AS line_id,
    strptime('20' || Date || lpad(Time, 6, '0'), '%Y%m%d%H%M%S') AS ts FROM @log_raw""")
def _(t):
    return parse_log(t("log_raw")).select("line_id", "ts")


@query("p3_drop_unkeyed", f"""SELECT COUNT(*) AS raw_lines, COUNT({KEY}) AS keyed_lines FROM @log_raw""")
def _(t):
    lines = parse_log(t("log_raw"))
    kept = P.drop_unkeyed(lines, "block_id").select("block_id")
    before = lines.agg(F.count(F.lit(1)).alias("raw_lines"), F.lit(1).alias("_one"))
    after = kept.agg(F.count(F.lit(1)).alias("keyed_lines"), F.lit(1).alias("_one"))
    return before.join(after, "_one").drop("_one")


TRANSFERS = rf"""SELECT regexp_extract(Content, 'src: /({IP}):', 1) AS src_ip,
    regexp_extract(Content, 'dest: /({IP}):', 1) AS dst_ip, {KEY} AS block_id FROM @log_raw
    WHERE regexp_matches(Content, 'src: /{IP}:[0-9]+ dest: /{IP}:[0-9]+')"""
REPLICAS = rf"""SELECT DISTINCT regexp_extract(Content, 'updated: ({IP}):', 1) AS host_ip,
    regexp_extract(Content, 'added to (blk_-?[0-9]+)', 1) AS block_id FROM @log_raw
    WHERE regexp_matches(Content, 'addStoredBlock: blockMap updated: {IP}:[0-9]+ is added to blk_')"""
REREPL = rf"""SELECT regexp_extract(Content, '^({IP})', 1) AS src_ip, regexp_extract(Content, 'to /({IP})', 1) AS dst_ip,
    {KEY} AS block_id FROM @log_raw WHERE EventId = 'E16'"""


@query("p4_extract_transfers", TRANSFERS)
def _(t):
    return P.extract_transfers(parse_log(t("log_raw")), "content", "block_id")


@query("p5_extract_placement", REPLICAS)
def _(t):
    return P.extract_placement(parse_log(t("log_raw")), "content")


@query("p6_extract_rereplication", REREPL)
def _(t):
    return P.extract_rereplication(parse_log(t("log_raw")), "content", "event_id", "block_id")


HARDWARE = """SELECT CAST(LineId AS INT) AS line_id, Label AS alert_type, Label <> '-' AS is_alert, Node AS node,
    CASE WHEN Node LIKE 'R%' THEN split_part(Node, '-', 1) END AS rack,
    CASE WHEN Node LIKE 'R%' THEN split_part(Node, '-', 2) END AS midplane,
    CASE WHEN Node LIKE 'R%' THEN split_part(split_part(Node, '-', 3), ':', 1) END AS node_card FROM @hardware_raw"""


@query("p7_parse_hierarchy", f"SELECT line_id, rack, midplane, node_card FROM ({HARDWARE})")
def _(t):
    return parse_hardware_log(t("hardware_raw")).select("line_id", "rack", "midplane", "node_card")


@query("p8_derive_alert_flag", f"SELECT line_id, is_alert FROM ({HARDWARE})")
def _(t):
    return parse_hardware_log(t("hardware_raw")).select("line_id", "is_alert")


@query("p9_epoch", """SELECT CAST(h.LineId AS INT) AS line_id, make_timestamp(CAST(h.Timestamp AS BIGINT) * 1000000) AS ts,
    round(epoch_us(e.ts) / 1e6, 6) AS seconds FROM @hardware_raw h JOIN @events e ON CAST(h.LineId AS BIGINT) = e.event_id""")
def _(t):
    lines = parse_hardware_log(t("hardware_raw")).select("line_id", F.col("ts"))
    stamps = t("events").select(F.col("event_id").cast("int").alias("line_id"),
                                F.round(P.ts_to_epoch(F.col("ts")), 6).alias("seconds"))
    return lines.join(stamps, "line_id")


@query("p10_subnet16", rf"""SELECT src_ip, dst_ip, split_part(src_ip, '.', 1) || '.' || split_part(src_ip, '.', 2) || '.0.0/16' AS subnet,
    split_part(src_ip, '.', 2) <> split_part(dst_ip, '.', 2) AS crosses FROM ({REREPL})""")
def _(t):
    moves = P.extract_rereplication(parse_log(t("log_raw")), "content", "event_id", "block_id")
    return moves.select("src_ip", "dst_ip", P.subnet16(F.col("src_ip")).alias("subnet"),
                        P.crosses_subnet(F.col("src_ip"), F.col("dst_ip")).alias("crosses"))


@query("p11_is_external_prefix", """SELECT flow_id, NOT (src_ip LIKE '192.168.%' OR src_ip LIKE '10.%' OR src_ip LIKE '172.16.%')
    AS external_src FROM @flows""")
def _(t):
    return t("flows").select("flow_id", P.is_external_prefix(F.col("src_ip")).alias("external_src"))


def external_sql(ip: str) -> str:
    """The CIDR test spelled out for the checking database."""
    o = [f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    valid = rf"regexp_full_match({ip}, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AND " + " AND ".join(f"{x} <= 255" for x in o)
    private = (f"({o[0]} = 10 OR ({o[0]} = 172 AND {o[1]} BETWEEN 16 AND 31) OR ({o[0]} = 192 AND {o[1]} = 168) "
               f"OR ({o[0]} = 100 AND {o[1]} BETWEEN 64 AND 127))")
    return f"CASE WHEN {valid} THEN NOT {private} ELSE contains({ip}, ':') END"


FLOW_RECORDS = """SELECT event_id, CAST(f[1] AS BIGINT) AS start_s, CAST(f[2] AS BIGINT) AS end_s, f[3] AS eni, f[4] AS src, f[5] AS dst,
    f[6] AS sport, TRY_CAST(f[7] AS INT) AS dport,
    CASE f[8] WHEN '6' THEN 'tcp' WHEN '17' THEN 'udp' WHEN '1' THEN 'icmp' ELSE f[8] END AS proto,
    CAST(f[9] AS BIGINT) AS packets, CAST(f[10] AS BIGINT) AS bytes, f[11] AS action
    FROM (SELECT event_id, string_split(message, ' ') AS f FROM @flow_log) x WHERE len(f) >= 12 AND f[4] <> '-'"""


def flow_records(t: Tables):
    return P.parse_flow_record(t("flow_log"), "message", "event_id")


@query("p12_is_external_cidr", f"""SELECT event_id, {external_sql('src')} AS external_src, {external_sql('dst')} AS external_dst
    FROM ({FLOW_RECORDS})""")
def _(t):
    return flow_records(t).select("event_id", P.is_external_cidr(F.col("src")).alias("external_src"),
                                  P.is_external_cidr(F.col("dst")).alias("external_dst"))


@query("p13_parse_flow_record", f"""SELECT event_id, start_s, end_s, eni, src, dst, sport, coalesce(CAST(dport AS VARCHAR), 'none') AS dport,
    proto, packets, bytes, action FROM ({FLOW_RECORDS})""")
def _(t):
    return flow_records(t).withColumn("dport", F.coalesce(F.col("dport").cast("string"), F.lit("none")))


@query("p14_is_reply", f"""SELECT event_id, action = 'ACCEPT' AND dport >= 32768 AS reply FROM ({FLOW_RECORDS}) WHERE dport IS NOT NULL""")
def _(t):
    return flow_records(t).filter(F.col("dport").isNotNull()).select(
        "event_id", P.is_reply(F.col("action"), F.col("dport")).alias("reply"))


INBOUND = f"""SELECT * FROM ({FLOW_RECORDS}) WHERE {external_sql('src')} AND NOT ({external_sql('dst')}) AND dport IS NOT NULL
    AND NOT (action = 'ACCEPT' AND dport >= 32768)"""


@query("p15_inbound_unsolicited", f"SELECT event_id, src, dst, dport, action FROM ({INBOUND})")
def _(t):
    return P.inbound_unsolicited(flow_records(t)).select("event_id", "src", "dst", "dport", "action")


REPUTATION = ("(signature ILIKE '%reputation%' OR signature ILIKE '%CINS%' OR signature ILIKE '%DROP%' "
              "OR signature ILIKE '%Dshield%' OR signature ILIKE '%Compromised%')")


@query("p16_is_reputation_signature", f"SELECT flow_id, signature, {REPUTATION} AS reputation FROM @alerts")
def _(t):
    return t("alerts").select("flow_id", "signature", P.is_reputation_signature(F.col("signature")).alias("reputation"))


@query("p17_point_lookup", """SELECT block_id, count(*) AS lines, count(DISTINCT host_ip) AS hosts FROM @block_lines
    WHERE block_id = 'blk_5979' GROUP BY block_id""")
def _(t):
    return t("block_lines").filter(F.col("block_id") == F.lit("blk_5979")).groupBy("block_id").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("host_ip").alias("hosts"))


PORT_RANGE = """SELECT sg_id, CASE WHEN proto = '-1' OR port_from IS NULL THEN 0 ELSE greatest(port_from, 0) END AS lo,
    CASE WHEN proto = '-1' OR port_from IS NULL THEN 65535 ELSE greatest(port_to, 0) END AS hi, cidr, proto FROM @sg_rules"""


def rules(t: Tables):
    return t("sg_rules").withColumn("cidrs", F.array(F.lit("10.1.0.0/16"), F.col("cidr")))


@query("p18_normalise_port_range", f"SELECT sg_id, lo, hi FROM ({PORT_RANGE})")
def _(t):
    low, high = P.normalise_port_range(F.col("proto"), F.col("port_from"), F.col("port_to"))
    return t("sg_rules").select("sg_id", low.alias("lo"), high.alias("hi"))


@query("p19_open_to_internet", "SELECT sg_id, cidr IN ('0.0.0.0/0', '::/0') AS is_open FROM @sg_rules")
def _(t):
    return rules(t).select("sg_id", P.open_to_internet(F.col("cidrs")).alias("is_open"))


ENTITIES = r"""SELECT qid, question,
    list_sort(list_distinct(regexp_extract_all(question, 'blk_-?[0-9]+'))) AS blocks,
    list_sort(list_distinct(regexp_extract_all(question, '\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\b'))) AS hosts,
    list_sort(regexp_extract_all(question, '\bR[0-9]{2}\b')) AS racks FROM @questions"""


@query("p20_extract_entities", f"""SELECT qid, array_to_string(blocks, ' ') AS blocks, array_to_string(hosts, ' ') AS hosts,
    array_to_string(racks, ' ') AS racks FROM ({ENTITIES})""")
def _(t):
    found = t("questions").select("qid", *P.extract_entities(F.col("question")))
    return found.select("qid", *[F.concat_ws(" ", F.array_sort(c)).alias(c) for c in ("blocks", "hosts", "racks")])


ROUTES = rf"""SELECT qid, regexp_matches(question, '(?i)\bhosts?\b|datanode') AND NOT regexp_matches(question, '\b{IP}\b') AS wants_all_hosts,
    regexp_matches(question, '(?i)\brack|BGL') OR regexp_matches(question, '\bR[0-9]{{2}}\b') AS wants_racks,
    regexp_matches(question, '(?i)scanning|scanners?\b|which sources?|attack sources|top attackers|probing') AS wants_scanners
    FROM @questions"""


@query("p21_route_question", ROUTES)
def _(t):
    return t("questions").select("qid", *P.route_question(F.col("question")))


@query("p22_combined_verdict", """SELECT b.block_id, coalesce(x.e, false) OR b.flag OR coalesce(x.risk, 0) >= 0.4 AS verdict
    FROM @blocks b LEFT JOIN (SELECT block_id, bool_or(event_id = 'E7') AS e, max(CASE WHEN event_id = 'E21' THEN 0.5 END) AS risk
      FROM @block_lines GROUP BY 1) x USING (block_id)""")
def _(t):
    per = t("block_lines").groupBy("block_id").agg(
        F.max(F.col("event_id").isin(P.EXCEPTION_TEMPLATES)).alias("e"),
        F.max(F.when(F.col("event_id") == "E21", 0.5)).alias("risk"))
    return t("blocks").join(per, "block_id", "left").select("block_id", P.combined_verdict(
        F.coalesce("e", F.lit(False)), F.col("flag"), F.col("risk"), 0.4).alias("verdict"))


@query("p23_exception_events", """SELECT block_id, string_agg(DISTINCT event_id, ' ' ORDER BY event_id) AS exceptions FROM
    (SELECT nullif(regexp_extract(Content, '(blk_-?[0-9]+)', 1), '') AS block_id, EventId AS event_id FROM @log_raw)
    WHERE event_id IN ('E7', 'E10', 'E14', 'E27', 'E8', 'E13') AND block_id IS NOT NULL GROUP BY 1""")
def _(t):
    per = parse_log(t("log_raw")).dropna(subset=["block_id"]).groupBy("block_id").agg(
        F.collect_set("event_id").alias("templates"))
    fired = per.select("block_id", P.exception_events(F.col("templates")).alias("e"))
    return fired.filter(F.size("e") > 0).select("block_id", F.concat_ws(" ", F.array_sort("e")).alias("exceptions"))


@query("p24_null_defaults", """SELECT o_orderkey, coalesce(n, 0) AS lines, coalesce(round(d, 6), 0) AS discount FROM @orders LEFT JOIN
    (SELECT l_orderkey, count(*) AS n, max(l_discount) AS d FROM @lineitem GROUP BY 1) x ON o_orderkey = l_orderkey""")
def _(t):
    per = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_discount").alias("d"))
    return t("orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce(F.round("d", 6), F.lit(0.0)).alias("discount"))


@query("f1_string_functions", """SELECT p_partkey, starts_with(p_name, 'small') AS small, split_part(p_brand, '#', 2) AS brand_no,
    lpad(CAST(p_size AS VARCHAR), 6, '0') AS padded, lower(p_type) AS kind, regexp_replace(p_name, 's$', '') AS stripped,
    p_type ILIKE '%pro%' AS promo, substr(p_name, 1, 4) AS head, trim('  ' || p_name || ' ') AS trimmed FROM @part""")
def _(t):
    return t("part").select(
        "p_partkey", F.startswith("p_name", F.lit("small")).alias("small"),
        F.split_part("p_brand", F.lit("#"), F.lit(2)).alias("brand_no"),
        F.lpad(F.col("p_size").cast("string"), 6, "0").alias("padded"), F.lower("p_type").alias("kind"),
        F.regexp_replace("p_name", "s$", "").alias("stripped"), F.col("p_type").ilike("%pro%").alias("promo"),
        F.substring("p_name", 1, 4).alias("head"),
        F.trim(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("trimmed"))


@query("f2_regex_functions", r"""SELECT doc_id, regexp_extract(text, '([0-9]+)', 1) AS first_number,
    len(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS ips, regexp_matches(text, '(?i)\bthe\b') AS has_the FROM @documents""")
def _(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id", F.regexp_extract(text, r"([0-9]+)", 1).alias("first_number"),
        F.size(P.find_all(text, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")).cast("bigint").alias("ips"), text.rlike(r"(?i)\bthe\b").alias("has_the"))


@query("f3_date_functions", """SELECT event_id, date_trunc('hour', ts) AS hour, epoch_us(ts) // 1000000 AS seconds,
    CAST(ts AS DATE) AS day, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS since FROM @events""")
def _(t):
    ts = F.col("ts")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return t("events").select(
        "event_id", F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"),
        F.floor(P.micros(ts) / 1_000_000).alias("seconds"), F.to_date(ts).alias("day"),
        ((P.micros(ts) - F.unix_micros(start)) / 1e6).alias("since"))


@query("f4_math_functions", """SELECT event_id, round(ln(1 + value), 6) AS log1p_value, round(ln(1 / greatest(least(value / 500, 1), 1e-12)), 6) AS nll,
    abs(value - 100) AS deviation, greatest(least(value, 200), 10) AS clipped, value / greatest(1, user_id) AS ratio FROM @events""")
def _(t):
    v = F.col("value")
    return t("events").select(
        "event_id", F.round(F.log1p(v), 6).alias("log1p_value"),
        F.round(F.log(1 / F.greatest(F.least(v / 500, F.lit(1.0)), F.lit(1e-12))), 6).alias("nll"),
        F.abs(v - 100).alias("deviation"), F.greatest(F.least(v, F.lit(200.0)), F.lit(10.0)).alias("clipped"),
        (v / F.greatest(F.lit(1), F.col("user_id"))).alias("ratio"))


@query("f5_array_functions", f"""SELECT qid, len(blocks) AS n_blocks, list_contains(hosts, '203.0.0.4') AS asks_first,
    len(list_intersect(blocks, ['blk_0', 'blk_7', 'blk_-5'])) AS known, coalesce(blocks[1], '') AS smallest FROM ({ENTITIES})""")
def _(t):
    found = t("questions").select("qid", *P.extract_entities(F.col("question")))
    return found.select(
        "qid", F.size("blocks").cast("bigint").alias("n_blocks"), F.array_contains("hosts", "203.0.0.4").alias("asks_first"),
        F.size(F.array_intersect("blocks", F.array(F.lit("blk_0"), F.lit("blk_7"), F.lit("blk_-5")))).cast("bigint").alias("known"),
        F.coalesce(F.get(F.array_sort("blocks"), F.lit(0)), F.lit("")).alias("smallest"))


@query("f6_json_functions", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    coalesce(json_extract_string(props, '$.missing'), 'none') AS optional,
    '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS document FROM @events""")
def _(t):
    parsed = F.from_json("props", "k bigint")
    return t("events").select(
        "event_id", parsed["k"].alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("optional"),
        F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_type").alias("type"))).alias("document"))


@query("f7_conditional_cast", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'P' THEN 'partial'
    ELSE 'open' END AS state, CAST(o_orderstatus = 'F' AS INT) AS failed, coalesce(TRY_CAST(o_orderpriority AS INT), -1) AS bad_number FROM @orders""")
def _(t):
    s = F.col("o_orderstatus")
    return t("orders").select(
        "o_orderkey", F.when(s == "F", "failed").when(s == "P", "partial").otherwise("open").alias("state"),
        (s == "F").cast("int").alias("failed"), F.coalesce(F.col("o_orderpriority").try_cast("int"), F.lit(-1)).alias("bad_number"))
