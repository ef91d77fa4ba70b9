"""Configuration and flow-log audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslattice.catalog.aggregates import BY_INTERFACE, FLOW_SUMMARY, PORTS, flow_summary, roles
from opslattice.catalog.base import Tables, query
from opslattice.catalog.joins import PROBED, UNATTACHED, UNNEEDED, probed
from opslattice.catalog.parsing import PORT_RANGE, flow_records, rules
from opslattice.functions import parsing as P
from opslattice.operators import audit as N

EXPOSED = f"""SELECT 'internet_exposed_rule' AS "check", 'info' AS severity, region, name || ' (' || CAST(r.sg_id AS VARCHAR) || ')' AS sg,
    proto || ' ' || CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) AS ports, r.sg_id IN (SELECT sg_id FROM @interfaces WHERE sg_id IS NOT NULL) AS attached
    FROM ({PORT_RANGE}) r JOIN @sg_groups g ON g.sg_id = r.sg_id WHERE cidr IN ('0.0.0.0/0', '::/0')"""
PROBED_EXPOSED = f"""SELECT 'probed_port_exposed' AS "check", 'medium' AS severity, region, name || ' (' || CAST(r.sg_id AS VARCHAR) || ')' AS sg, dest_port AS port,
    flows, alerted, sources FROM ({PORT_RANGE}) r JOIN @sg_groups g ON g.sg_id = r.sg_id JOIN ({PROBED}) p ON dest_port BETWEEN lo AND hi AND alerted > 0
    WHERE cidr IN ('0.0.0.0/0', '::/0')"""
PLAINTEXT = """SELECT 'plaintext_listener' AS "check", 'medium' AS severity, region, load_balancer, string_agg(DISTINCT protocol, ',' ORDER BY protocol) AS listeners
    FROM @listeners WHERE scheme = 'internet-facing' GROUP BY 3, 4 HAVING bool_or(protocol = 'HTTP') AND NOT bool_or(protocol = 'HTTPS')"""
COUNTS = f"""SELECT severity, "check", count(*) AS n FROM (SELECT severity, "check" FROM ({EXPOSED}) UNION ALL SELECT severity, "check" FROM ({PROBED_EXPOSED})
    UNION ALL SELECT severity, "check" FROM ({PLAINTEXT}) UNION ALL SELECT 'low', 'unneeded_public_ip' FROM ({UNNEEDED}) UNION ALL SELECT 'low', 'unattached_sg' FROM ({UNATTACHED})) GROUP BY 1, 2"""


def findings(t: Tables):
    return N.audit_config(t("sg_groups"), rules(t), t("interfaces"), t("listeners"), probed(t))


@query("n1_audit_exposed_rules", EXPOSED)
def _(t):
    return N.audit_exposed_rules(t("sg_groups"), rules(t), t("interfaces"))


@query("n2_audit_probed_ports", PROBED_EXPOSED)
def _(t):
    return N.audit_probed_ports(t("sg_groups"), rules(t), probed(t))


@query("n3_audit_plaintext_listeners", PLAINTEXT)
def _(t):
    return N.audit_plaintext_listeners(t("listeners"))


@query("n4_audit_public_unattached", f"""SELECT 'unneeded_public_ip' AS "check", region, eni AS subject FROM ({UNNEEDED}) UNION ALL SELECT 'unattached_sg', region, sg FROM ({UNATTACHED})""")
def _(t):
    public = N.audit_public_ips(rules(t), t("interfaces")).select("check", "region", F.col("eni").alias("subject"))
    return public.union(N.audit_unattached(t("sg_groups"), t("interfaces")).select("check", "region", F.col("sg").alias("subject")))


@query("n5_audit_report", COUNTS)
def _(t):
    return N.findings_by_severity(findings(t))


@query("u5_union_findings", f"""SELECT "check", severity, region, coalesce(sg, '') AS sg, coalesce(ports, '') AS ports, coalesce(CAST(port AS VARCHAR), '') AS port, coalesce(load_balancer, '') AS load_balancer, coalesce(eni, '') AS eni FROM
    (SELECT "check", severity, region, sg, ports, NULL AS port, NULL AS load_balancer, NULL AS eni FROM ({EXPOSED}) UNION ALL SELECT "check", severity, region, sg, NULL, port, NULL, NULL FROM ({PROBED_EXPOSED})
     UNION ALL SELECT "check", severity, region, NULL, NULL, NULL, load_balancer, NULL FROM ({PLAINTEXT}) UNION ALL SELECT 'unneeded_public_ip', 'low', region, NULL, NULL, NULL, NULL, eni FROM ({UNNEEDED})
     UNION ALL SELECT 'unattached_sg', 'low', region, sg, NULL, NULL, NULL, NULL FROM ({UNATTACHED}))""")
def _(t):
    sparse = ["sg", "ports", "port", "load_balancer", "eni"]
    return findings(t).select("check", "severity", "region", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in sparse])


@query("a27_findings_summary", f"""SELECT dest_port, alerted, dest_port IN (SELECT port FROM ({PROBED_EXPOSED})) AS exposed FROM ({PROBED}) ORDER BY alerted DESC, dest_port LIMIT 10""")
def _(t):
    return N.exposed_top_ports(findings(t), probed(t))


@query("n6_audit_flow_log", f"""SELECT 'port' AS part, proto || ' ' || CAST(port AS VARCHAR) AS subject, flows, sources, accepted, rejected FROM ({PORTS}) UNION ALL
    SELECT 'interface', role, flows, sources, accepted, flows - accepted FROM ({BY_INTERFACE}) UNION ALL
    SELECT 'total', 'inbound', inbound_external_flows, external_sources, inbound_external_flows - rejected_flows, rejected_flows FROM ({FLOW_SUMMARY})""")
def _(t):
    records = flow_records(t)
    inbound = P.inbound_unsolicited(records)
    ports = N.port_accept_reject(inbound).select(
        F.lit("port").alias("part"), F.concat("proto", F.lit(" "), F.col("port").cast("string")).alias("subject"),
        "flows", "sources", "accepted", "rejected")
    faces = N.by_interface(inbound, roles(t)).select(
        F.lit("interface").alias("part"), F.col("role").alias("subject"), "flows", "sources", "accepted",
        (F.col("flows") - F.col("accepted")).alias("rejected"))
    total = flow_summary(t).select(
        F.lit("total").alias("part"), F.lit("inbound").alias("subject"), F.col("inbound_external_flows").alias("flows"),
        F.col("external_sources").alias("sources"),
        (F.col("inbound_external_flows") - F.col("rejected_flows")).alias("accepted"), F.col("rejected_flows").alias("rejected"))
    return ports.union(faces).union(total)
