"""Exposure audit of network configuration and accept/reject audit of flow logs.

The configuration comes as flat tables (see sources.readers.read_config_snapshot):
groups(region, sg_id, name), rules(sg_id, proto, port_from, port_to, cidrs),
interfaces(region, eni, type, public_ip, sg_id) with one row per attached group,
listeners(region, load_balancer, scheme, protocol).
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.functions import parsing as P
from opslattice.operators.relational import range_join, top_k


def _named_group():
    return F.concat(F.col("name"), F.lit(" ("), F.col("sg_id").cast("string"), F.lit(")"))


def exposed_rules(rules: DataFrame) -> DataFrame:
    low, high = P.normalise_port_range(F.col("proto"), F.col("port_from"), F.col("port_to"))
    return rules.filter(P.open_to_internet(F.col("cidrs"))).select("sg_id", "proto", low.alias("lo"), high.alias("hi"))


def audit_exposed_rules(groups: DataFrame, rules: DataFrame, interfaces: DataFrame) -> DataFrame:
    attached = interfaces.select("sg_id").dropna().distinct().withColumn("_att", F.lit(True))
    ports = F.concat(F.col("proto"), F.lit(" "), F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    return exposed_rules(rules).join(groups, "sg_id").join(attached, "sg_id", "left").select(
        F.lit("internet_exposed_rule").alias("check"), F.lit("info").alias("severity"), "region",
        _named_group().alias("sg"), ports.alias("ports"), F.coalesce("_att", F.lit(False)).alias("attached"))


def audit_probed_ports(groups: DataFrame, rules: DataFrame, probed: DataFrame) -> DataFrame:
    """Exposed rules that cover a port with alerted probes; protocol is not compared."""
    alerted = probed.filter(F.col("alerted") > 0)
    hits = range_join(exposed_rules(rules).join(groups, "sg_id"), alerted, "lo", "hi", "dest_port")
    return hits.select(
        F.lit("probed_port_exposed").alias("check"), F.lit("medium").alias("severity"), "region",
        _named_group().alias("sg"), F.col("dest_port").alias("port"), "flows", "alerted", "sources")


def audit_plaintext_listeners(listeners: DataFrame) -> DataFrame:
    per = listeners.filter(F.col("scheme") == "internet-facing").groupBy("region", "load_balancer").agg(
        F.max(F.col("protocol") == "HTTP").alias("_http"), F.max(F.col("protocol") == "HTTPS").alias("_https"),
        F.concat_ws(",", F.array_sort(F.collect_set("protocol"))).alias("listeners"))
    return per.filter(F.col("_http") & ~F.col("_https")).select(
        F.lit("plaintext_listener").alias("check"), F.lit("medium").alias("severity"), "region", "load_balancer", "listeners")


def audit_public_ips(rules: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Public interfaces none of whose groups admits internet traffic."""
    exposed = exposed_rules(rules).select("sg_id").distinct().withColumn("_open", F.lit(True))
    reachable = interfaces.filter("public_ip").join(exposed, "sg_id", "left")
    per = reachable.groupBy("region", "eni", "type").agg(F.max(F.coalesce("_open", F.lit(False))).alias("_open"))
    return per.filter(~F.col("_open")).select(
        F.lit("unneeded_public_ip").alias("check"), F.lit("low").alias("severity"), "region",
        F.col("eni").cast("string").alias("eni"), "type")


def audit_unattached(groups: DataFrame, interfaces: DataFrame) -> DataFrame:
    unused = groups.filter(F.col("name") != "default").join(
        interfaces.select("sg_id").dropna().distinct(), "sg_id", "left_anti")
    return unused.select(F.lit("unattached_sg").alias("check"), F.lit("low").alias("severity"), "region",
                         _named_group().alias("sg"))


def audit_config(groups: DataFrame, rules: DataFrame, interfaces: DataFrame, listeners: DataFrame,
                 probed: DataFrame) -> DataFrame:
    """All findings of the five checks with one sparse set of columns."""
    parts = [
        audit_exposed_rules(groups, rules, interfaces), audit_probed_ports(groups, rules, probed),
        audit_plaintext_listeners(listeners), audit_public_ips(rules, interfaces), audit_unattached(groups, interfaces),
    ]
    return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)


def findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n"))


def exposed_top_ports(findings: DataFrame, probed: DataFrame, k: int = 10) -> DataFrame:
    """The k most alerted ports and whether an exposed rule covers them."""
    covered = findings.filter(F.col("check") == "probed_port_exposed").select(
        F.col("port").alias("dest_port")).distinct().withColumn("_hit", F.lit(True))
    top = top_k(probed, k, [F.desc("alerted"), F.asc("dest_port")])
    return top.join(covered, "dest_port", "left").select(
        "dest_port", "alerted", F.coalesce("_hit", F.lit(False)).alias("exposed"))


# ---------------------------------------------------------------- flow logs
def port_accept_reject(inbound: DataFrame) -> DataFrame:
    accepted = F.col("action") == "ACCEPT"
    return inbound.groupBy("proto", F.col("dport").alias("port")).agg(
        F.count(F.lit(1)).alias("flows"), F.countDistinct("src").alias("sources"),
        F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))


def top_ports(ports: DataFrame, k: int = 15) -> DataFrame:
    return top_k(ports, k, [F.desc("sources"), F.desc("flows"), F.asc("port"), F.asc("proto")])


def by_interface(inbound: DataFrame, roles: DataFrame) -> DataFrame:
    """roles(eni, role): interfaces without a role report under their own id."""
    named = inbound.join(roles, "eni", "left").withColumn("role", F.coalesce("role", "eni"))
    return named.groupBy("role").agg(
        F.count(F.lit(1)).alias("flows"), F.countDistinct("src").alias("sources"),
        F.count_if(F.col("action") == "ACCEPT").alias("accepted"))


def flow_audit_summary(records: DataFrame, exposed_ports: tuple[int, ...] = (80,)) -> DataFrame:
    """One row of totals over parsed records, in one pass over them."""
    inbound = P.is_external_cidr(F.col("src")) & ~P.is_external_cidr(F.col("dst")) & F.col("dport").isNotNull()
    reply = P.is_reply(F.col("action"), F.col("dport"))
    marked = records.withColumn("_in", F.coalesce(inbound & ~reply, F.lit(False))).withColumn(
        "_reply", F.coalesce(inbound & reply, F.lit(False)))
    accepted = F.col("_in") & (F.col("action") == "ACCEPT")
    ports = F.array_sort(F.collect_set(F.when(accepted, F.col("dport"))))  # ports number at most 65536
    expected = F.array(*[F.lit(p) for p in exposed_ports])
    row = marked.agg(
        F.round((F.max("end_s") - F.min("start_s")) / 60, 1).alias("window_minutes"),
        F.count(F.lit(1)).alias("records"), F.count_if("_in").alias("inbound_external_flows"),
        F.count_if("_reply").alias("reply_flows_excluded"),
        F.countDistinct(F.when(F.col("_in"), F.col("src"))).alias("external_sources"),
        F.countDistinct(F.when(F.col("_in"), F.struct("proto", "dport"))).alias("distinct_ports_probed"),
        ports.alias("_ports"), F.count_if(F.col("_in") & (F.col("action") != "ACCEPT")).alias("rejected_flows"))
    return row.select(
        "window_minutes", "records", "inbound_external_flows", "reply_flows_excluded", "external_sources",
        "distinct_ports_probed", F.concat_ws(",", F.transform("_ports", lambda p: p.cast("string"))).alias("accepted_ports"),
        F.concat_ws(",", F.transform(F.array_except("_ports", expected), lambda p: p.cast("string"))).alias("unexpected_ports"),
        "rejected_flows",
        (F.col("rejected_flows") / F.greatest(F.col("inbound_external_flows"), F.lit(1))).alias("rejected_share"))
