"""Sources, sinks and quality gates."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from opslattice.catalog.aggregates import EVENTS, LINE_TEMPLATES, SESSIONS
from opslattice.catalog.base import Tables, query
from opslattice.catalog.detectors import vectors
from opslattice.catalog.joins import SPLIT, keyed_log, log_sessions, signatures, split_blocks
from opslattice.functions import parsing as P
from opslattice.operators import detection as D
from opslattice.operators import quality as Q
from opslattice.operators.retrieval import incident_cards
from opslattice.operators.sessions import parse_log
from opslattice.plans.runtime import durable, shared_dir
from opslattice.sources import readers, writers


def folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


LOG_COLUMNS = "LineId, Date, Time, Level, Component, Content, EventId, EventTemplate"


@query("s1_read_structured_log", f"SELECT {LOG_COLUMNS} FROM @log_raw")
def _(t):
    path = folder(t, "log")
    t("log_raw").select(*LOG_COLUMNS.split(", ")).write.option("header", True).option("escape", '"').csv(path)
    return readers.read_structured_log(t.spark, path)


@query("s2_read_eve", """SELECT 'flow' AS kind, event_id AS flow_id, 'pkts ' || CAST(k AS VARCHAR) || ' alerted ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS detail FROM @ev WHERE event_type = 'view'
    UNION ALL SELECT 'alert', event_id, 'ET SCAN ' || CAST(k AS VARCHAR) || ' severity ' || CAST(1 + k % 3 AS VARCHAR) FROM @ev WHERE event_type = 'error'
    UNION ALL SELECT 'dns', event_id, CASE WHEN k % 2 = 0 THEN 'query' ELSE 'host' || CAST(k AS VARCHAR) END FROM @ev WHERE event_type = 'click'
    UNION ALL SELECT 'anomaly', event_id, CASE WHEN k % 2 = 0 THEN 'stream' ELSE 'none' END FROM @ev WHERE event_type = 'signup'""")
def _(t):
    parts = readers.split_eve(readers.eve_from_text(t("eve_lines"), "line"))
    text = lambda c: F.col(c).cast("string")
    flow = parts["flows"].select(F.lit("flow").alias("kind"), "flow_id", F.concat(
        F.lit("pkts "), text("pkts_toserver"), F.lit(" alerted "), text("alerted")).alias("detail"))
    alert = parts["alerts"].select(F.lit("alert"), "flow_id", F.concat("signature", F.lit(" severity "), text("severity")))
    dns = parts["dns"].select(F.lit("dns"), "flow_id", F.coalesce("dns_type", "rrname"))
    anomaly = parts["anomalies"].select(F.lit("anomaly"), "flow_id", F.coalesce("anomaly_event", F.lit("none")))
    return flow.union(alert).union(dns).union(anomaly)


@query("s2_missing_required", """SELECT CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'flow' WHEN 'click' THEN 'dns' WHEN 'signup' THEN 'anomaly' ELSE 'stats' END AS event_type,
    count(*) AS n, CAST(0 AS BIGINT) AS lacking FROM @events GROUP BY 1""")
def _(t):
    return readers.missing_required(readers.eve_from_text(t("eve_lines"), "line"))


@query("s3_read_config_snapshot", """SELECT sg_id, region, name, port_from IS NULL AS open_range, cidr FROM @sg_rules JOIN @sg_groups USING (sg_id)""")
def _(t):
    # one document per security group, written and read back as nested JSON
    rule = F.struct("proto", F.col("port_from").alias("from"), F.col("port_to").alias("to"), F.array("cidr").alias("cidrs"))
    group = F.struct(F.col("sg_id").cast("string").alias("id"), "name", F.array(rule).alias("rules"))
    documents = t("sg_rules").join(t("sg_groups"), "sg_id").select(
        F.array(F.struct("region", F.array(group).alias("security_groups"))).alias("regions"))
    path = folder(t, "snapshot")
    documents.write.json(path)
    flat = readers.flatten_snapshot(t.spark.read.schema(readers.SNAPSHOT_SCHEMA).json(path))
    return flat["rules"].join(flat["groups"], "sg_id").select(
        F.col("sg_id").cast("bigint").alias("sg_id"), "region", "name", F.col("port_from").isNull().alias("open_range"),
        F.get("cidrs", F.lit(0)).alias("cidr"))


@query("s4_read_flow_log", """SELECT CAST(string_split(message, ' ')[1] AS BIGINT) AS start_s, string_split(message, ' ')[4] AS src, string_split(message, ' ')[11] AS action
    FROM @flow_log WHERE len(string_split(message, ' ')) >= 12 AND string_split(message, ' ')[4] <> '-'""")
def _(t):
    path = folder(t, "flowlog")
    t("flow_log").select(F.to_json(F.struct("message")).alias("value")).write.text(path)
    return readers.read_flow_log(t.spark, path).select("start_s", "src", "action")


@query("s5_read_scores", "SELECT block_id, residual, flag FROM @blocks")
def _(t):
    return readers.read_scores(t.spark, _write(t, "scores", writers.write_scores, t("blocks").select("block_id", "residual", "flag")))


def _write(t: Tables, name: str, writer, df) -> str:
    path = folder(t, name)
    writer(df, path)
    return path


@query("s6_read_answers_prompts", "SELECT i, run, answer, latency_ms, type, truth FROM @answers JOIN @prompts USING (i)")
def _(t):
    answers = _write(t, "answers", writers.write_json, t("answers").withColumnRenamed("run", "model"))
    prompts = _write(t, "prompts", writers.write_json, t("prompts"))
    joined = readers.read_answers(t.spark, answers).join(readers.read_prompts(t.spark, prompts), "i")
    return joined.select("i", F.col("model").alias("run"), "answer", "latency_ms", "type", "truth")


@query("s7_load_table", "SELECT block_id, count(*) AS n FROM @block_lines GROUP BY 1")
def _(t):
    name = f"stored_{uuid.uuid4().hex[:8]}"
    readers.load_table(t.spark, t("block_lines"), name, folder(t, "tables"))
    return t.spark.sql(f"SELECT block_id, count(*) AS n FROM {name} GROUP BY block_id")


@query("s8_write_csv", "SELECT src_ip, dest_port, count(*) AS flows FROM @flows GROUP BY 1, 2")
def _(t):
    edges = t("flows").groupBy("src_ip", "dest_port").agg(F.count(F.lit(1)).alias("flows"))
    return writers.write_csv(edges, folder(t, "edges"))


@query("s9_write_json", "SELECT flow_id, signature, severity FROM @alerts")
def _(t):
    return writers.write_json(t("alerts").select("flow_id", "signature", "severity"), folder(t, "items"))


@query("s10_save_load_model")
def _(t):
    train = vectors(t).filter("split = 'train'")
    path = folder(t, "model")
    model, idf = D.fit_logreg_counts(train, LINE_TEMPLATES, "is_anomaly")
    writers.save_model(t.spark, path, {"columns": LINE_TEMPLATES, "idf": idf}, model)
    params, loaded = writers.load_model(t.spark, path, with_model=True)
    test = vectors(t).filter("split = 'test'")
    scored = D.score_logreg_counts(test, params["columns"], (loaded, params["idf"]))
    return scored.select("block_id", F.round("score", 6).alias("score"))


@query("s10_save_load_scorer")
def _(t):
    """Scores and flags of a pipeline that was fitted, saved and loaded: scaler, components and threshold of the residual detector."""
    counts = durable(vectors(t))
    path = folder(t, "scorer")
    Pipeline(stages=[D.AnomalyScorer("residual", LINE_TEMPLATES)]).fit(counts.filter("split = 'train'")).write().save(path)
    scored = PipelineModel.load(path).transform(counts.filter("split = 'test'"))
    return scored.select("block_id", F.round("score", 6).alias("score"), "flag")


def gate_sql(name: str, expected: str, actual: str, ok: str, source: str) -> str:
    return f"SELECT '{name}' AS gate, CAST({expected} AS VARCHAR) AS expected, CAST({actual} AS VARCHAR) AS actual, {ok} AS ok FROM {source}"


@query("q1_gate_row_count", gate_sql("row_count", "10000", "count(*)", "count(*) = 10000", f"({EVENTS})"))
def _(t):
    return Q.gate_row_count(keyed_log(t), 10000)


@query("q2_gate_unique", gate_sql("unique", "0", "count(*) - count(DISTINCT block_id)", "count(*) = count(DISTINCT block_id)", f"({SESSIONS})"))
def _(t):
    return Q.gate_unique(log_sessions(t), "block_id")


@query("q3_gate_no_orphans", gate_sql("no_orphans", "0", "count(*)", "count(*) = 0", f"({EVENTS}) WHERE block_id NOT IN (SELECT block_id FROM ({SESSIONS}))"))
def _(t):
    return Q.gate_no_orphans(keyed_log(t), log_sessions(t), "block_id")


@query("q4_gate_chronological", gate_sql(
    "chronological", "epoch_us(min(first_ts) FILTER (WHERE split = 'test'))", "epoch_us(max(first_ts) FILTER (WHERE split = 'train'))",
    "max(first_ts) FILTER (WHERE split = 'train') <= min(first_ts) FILTER (WHERE split = 'test')", f"({SPLIT})"))
def _(t):
    return Q.gate_chronological(split_blocks(t), "first_ts")


@query("q5_gate_no_leakage", gate_sql("no_leakage", "0", "count(*)", "count(*) = 0", f"({SPLIT}) a JOIN ({SPLIT}) b USING (block_id) WHERE a.split = 'train' AND b.split = 'test'"))
def _(t):
    rows = signatures(t).join(split_blocks(t).select("block_id", "split", "is_anomaly"), "block_id")
    return Q.gate_no_leakage(incident_cards(rows.filter("split = 'train'")), rows.filter("split = 'test'"), "id", "block_id")
