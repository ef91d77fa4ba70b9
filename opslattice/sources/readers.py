"""Readers with explicit schemas; everything textual arrives as string and is cast later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslattice.functions.parsing import parse_flow_record

# Column layouts of the inputs.
LOG_SCHEMA = ("LineId string, Date string, Time string, Level string, Component string, Content string, "
              "EventId string, EventTemplate string")
HARDWARE_SCHEMA = ("LineId string, Label string, Timestamp string, Node string, Component string, Level string, "
                   "Content string, EventId string, EventTemplate string")
LABEL_SCHEMA = "BlockId string, Label string"
EVE_SCHEMA = (
    "timestamp string, flow_id bigint, src_ip string, src_port int, dest_ip string, dest_port int, proto string, "
    "event_type string, app_proto string, "
    "flow struct<pkts_toserver:bigint,pkts_toclient:bigint,bytes_toserver:bigint,bytes_toclient:bigint,"
    "start:string,end:string,state:string,reason:string,alerted:boolean>, "
    "alert struct<signature_id:bigint,signature:string,category:string,severity:int>, "
    "dns struct<type:string,rrname:string>, anomaly struct<event:string>"
)
SNAPSHOT_SCHEMA = (
    "captured string, regions array<struct<region:string,vpcs:array<struct<`default`:boolean>>,"
    "security_groups:array<struct<id:string,name:string,rules:array<struct<proto:string,`from`:int,`to`:int,"
    "cidrs:array<string>,sg_refs:array<string>,prefix_lists:array<string>>>>>,"
    "enis:array<struct<id:string,type:string,public_ip:boolean,sgs:array<string>>>,"
    "load_balancers:array<struct<name:string,scheme:string,listeners:array<struct<protocol:string,port:int>>>>>>"
)
ANSWER_SCHEMA = "i bigint, answer string, model string, latency_ms double"
PROMPT_SCHEMA = ("i bigint, type string, truth string, question string, system string, user string, "
                 "retrieved array<string>")
BASE_FIELDS = ["timestamp", "flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto"]


def read_structured_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def split_eve(events: DataFrame) -> dict[str, DataFrame]:
    """flow, alert, dns and anomaly rows of one event stream; other types are left out.

    Fields that the format requires are checked by `missing_required`.
    """
    def at(name: str) -> Column:
        return F.to_timestamp(name).cast("timestamp_ntz")

    base = [F.col(c) for c in BASE_FIELDS[1:]]
    kind = F.col("event_type")
    return {
        "flows": events.filter(kind == "flow").select(
            at("timestamp").alias("timestamp"), *base, "app_proto", "flow.pkts_toserver", "flow.pkts_toclient",
            "flow.bytes_toserver", "flow.bytes_toclient", at("flow.start").alias("start_ts"),
            at("flow.end").alias("end_ts"), "flow.state", "flow.reason", "flow.alerted"),
        "alerts": events.filter(kind == "alert").select(
            at("timestamp").alias("timestamp"), *base, "alert.signature_id", "alert.signature", "alert.category",
            "alert.severity"),
        "dns": events.filter(kind == "dns").select(
            at("timestamp").alias("timestamp"), *base, F.col("dns.type").alias("dns_type"), "dns.rrname"),
        "anomalies": events.filter(kind == "anomaly").select(
            at("timestamp").alias("timestamp"), *base, F.col("anomaly.event").alias("anomaly_event")),
    }


def missing_required(events: DataFrame) -> DataFrame:
    """Number of events per type that lack a required payload field; must be all zero."""
    kind = F.col("event_type")
    flow = ["pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "start", "end", "state", "alerted"]
    alert = ["signature_id", "signature", "category", "severity"]
    lacking = (
        F.when(kind == "flow", F.greatest(*[F.col(f"flow.{c}").isNull() for c in flow]))
        .when(kind == "alert", F.greatest(*[F.col(f"alert.{c}").isNull() for c in alert]))
        .otherwise(F.lit(False))
    )
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(lacking).alias("lacking"))


def eve_from_text(lines: DataFrame, column: str) -> DataFrame:
    return lines.select(F.from_json(column, EVE_SCHEMA).alias("e")).select("e.*")


def read_eve(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return split_eve(spark.read.schema(EVE_SCHEMA).option("mode", "FAILFAST").json(path))


def flatten_snapshot(documents: DataFrame) -> dict[str, DataFrame]:
    """Nested configuration documents to the flat tables of the audit."""
    region = documents.select(F.explode("regions").alias("r"))
    group = region.select(F.col("r.region").alias("region"), F.explode("r.security_groups").alias("g"))
    rule = group.select(F.col("g.id").alias("sg_id"), F.explode("g.rules").alias("x"))
    eni = region.select(F.col("r.region").alias("region"), F.explode("r.enis").alias("n"))
    lb = region.select(F.col("r.region").alias("region"), F.explode("r.load_balancers").alias("b"))
    return {
        "groups": group.select("region", F.col("g.id").alias("sg_id"), F.col("g.name").alias("name")),
        "rules": rule.select("sg_id", "x.proto", F.col("x.from").alias("port_from"), F.col("x.to").alias("port_to"), "x.cidrs"),
        "interfaces": eni.select("region", F.col("n.id").alias("eni"), F.col("n.type").alias("type"),
                                 F.col("n.public_ip").alias("public_ip"), F.explode_outer("n.sgs").alias("sg_id")),
        "listeners": lb.select("region", F.col("b.name").alias("load_balancer"), F.col("b.scheme").alias("scheme"),
                               F.explode_outer("b.listeners.protocol").alias("protocol")),
    }


def read_config_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return flatten_snapshot(spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).json(path))


def flow_log_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """{'message': '<record>'} lines to parsed records; blank lines are skipped."""
    kept = lines.filter(F.trim(column) != "")
    return parse_flow_record(kept.select(F.from_json(column, "message string")["message"].alias("message")), "message")


def read_flow_log(spark: SparkSession, path: str) -> DataFrame:
    return flow_log_messages(spark.read.text(path))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANSWER_SCHEMA).json(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """truth changes its type per row and is kept as JSON text."""
    return spark.read.schema(PROMPT_SCHEMA).json(path)


def load_table(spark: SparkSession, df: DataFrame, name: str, folder: str) -> DataFrame:
    """Replace the stored table `name` and register it as a view."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored
