"""Aggregates, joins, rankings and set operations over typed telemetry tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- joins
def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def not_in(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """SQL NOT IN: any null among the others leaves no row; otherwise null keys drop out when others exist.

    The null test is one counted row, so the join itself stays an ordinary anti join.
    """
    state = others.agg(
        F.count_if(F.col(key).isNull()).alias("_nulls"), F.count(F.lit(1)).alias("_others"), F.lit(1).alias("_one"))
    kept = rows.join(others.select(key).distinct(), key, "left_anti").withColumn("_one", F.lit(1))
    kept = kept.join(F.broadcast(state), "_one")  # one row
    allowed = (F.col("_nulls") == 0) & (F.col(key).isNotNull() | (F.col("_others") == 0))
    return kept.filter(allowed).select(*rows.columns)


def dictionary_lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    return rows.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, default))


def full_outer_filled(left: DataFrame, right: DataFrame, key: str, zeros: list[str]) -> DataFrame:
    joined = left.join(right, key, "full")
    return joined.fillna(0, subset=zeros)


PORTS_PER_CELL = 256


def range_join(rules: DataFrame, points: DataFrame, low: str, high: str, point: str) -> DataFrame:
    """Rules joined to the points inside [low, high] as an equi-join on 256-wide cells.

    Only the distinct ranges are spread over the cells they touch, at most 65536 / 256 each; a range and a point meet in one cell, and the
    rules join the points of their range. Spark sizes a broadcast by the rows before the spread, so both joins are merge joins.
    """
    cells = F.sequence(F.floor(F.col("_low") / PORTS_PER_CELL), F.floor(F.col("_high") / PORTS_PER_CELL))
    ranges = rules.filter(F.col(low) <= F.col(high)).select(F.col(low).alias("_low"), F.col(high).alias("_high")).distinct()
    spread = ranges.withColumn("_cell", F.explode(cells))
    placed = points.withColumn("_cell", F.floor(F.col(point) / PORTS_PER_CELL))
    met = spread.hint("merge").join(placed, "_cell").filter(F.col(point).between(F.col("_low"), F.col("_high"))).drop("_cell")
    return rules.hint("merge").join(met, (F.col(low) == F.col("_low")) & (F.col(high) == F.col("_high"))).drop("_low", "_high")


def result_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one result that the other lacks, with their side."""
    columns = a.columns
    return a.exceptAll(b.select(*columns)).withColumn("side", F.lit("left")).union(
        b.select(*columns).exceptAll(a).withColumn("side", F.lit("right")))


# ---------------------------------------------------------------- flows and alerts
def flow_edges(flows: DataFrame) -> DataFrame:
    return flows.groupBy("src_ip", "dest_ip", "dest_port", "proto").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("alerted").alias("alerted_flows"),
        F.sum("pkts_toserver").alias("pkts"), F.sum("bytes_toserver").alias("bytes"))


def alert_edges(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("src_ip", "signature_id").agg(
        F.min("signature").alias("signature"), F.min("category").alias("category"), F.count(F.lit(1)).alias("hits"))


def fan_out(flows: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct ports and targets per source; `approximate` trades exactness for sketches."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return flows.groupBy("src_ip").agg(
        distinct("dest_port").alias("ports"), distinct("dest_ip").alias("dests"), F.count(F.lit(1)).alias("flows"))


def probed_ports(flows: DataFrame) -> DataFrame:
    return flows.filter(F.col("dest_port").isNotNull()).groupBy("dest_port").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("alerted").alias("alerted"), F.countDistinct("src_ip").alias("sources"))


def source_summary(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per source: flows, ports, alerted flows, first and last seen, alerts and top signatures.

    `alerts_top3` adds up the three most frequent signatures only, `alerts` all of them.
    """
    f = flows.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.countDistinct("dest_port").alias("distinct_dest_ports"),
        F.count_if("alerted").alias("alerted_flows"), F.min("start_ts").alias("first_seen"),
        F.max("start_ts").alias("last_seen"))
    signatures = alerts.groupBy("src_ip", "signature", "category").agg(F.count(F.lit(1)).alias("n"))
    total = signatures.groupBy("src_ip").agg(F.sum("n").alias("alerts"))
    top = top_per_key(signatures, "src_ip", [F.desc("n"), F.asc("signature"), F.asc("category")], 3)
    text = F.concat(F.col("signature"), F.lit(" ("), F.col("category"), F.lit(") x"), F.col("n").cast("string"))
    named = top.groupBy("src_ip").agg(
        F.sum("n").alias("alerts_top3"),
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), text.alias("s")))).alias("_s"),
    ).withColumn("top_signatures", F.concat_ws("; ", "_s.s")).drop("_s")
    zero = ["flows", "distinct_dest_ports", "alerted_flows", "alerts", "alerts_top3"]
    return f.join(total.join(named, "src_ip"), "src_ip", "full").fillna(0, subset=zero).fillna("", subset=["top_signatures"])


def mode_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; the smallest wins a tie."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return top_per_key(counts, key, [F.desc("n"), F.asc(value)], 1).drop("rank")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


# ---------------------------------------------------------------- ranking
def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows per key; Spark also cuts to k per key before the shuffle."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- sets
def union_distinct(*columns: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, columns).distinct()


def set_algebra(memberships: DataFrame, key: str, member: str, a: str, b: str) -> DataFrame:
    """Per key: |A n B|, A subset of B, A = B, from rows with boolean columns a and b.

    Works on counts of distinct members, so no set is ever held in one place.
    """
    flags = memberships.groupBy(key, member).agg(F.max(a).alias("_a"), F.max(b).alias("_b"))
    only_a, only_b = F.count_if(F.col("_a") & ~F.col("_b")), F.count_if(F.col("_b") & ~F.col("_a"))
    return flags.groupBy(key).agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("common"), (only_a == 0).alias("subset"),
        ((only_a == 0) & (only_b == 0)).alias("equal"))


def partition_difference(a: DataFrame, b: DataFrame, member: str, group: str) -> DataFrame:
    """Members whose group differs between two groupings, groups named by their smallest member."""
    def canonical(df: DataFrame, name: str) -> DataFrame:
        first = df.groupBy(group).agg(F.min(member).alias(name))
        return df.join(first, group).select(member, name)

    both = canonical(a, "left_group").join(canonical(b, "right_group"), member, "full")
    return both.filter(~F.col("left_group").eqNullSafe(F.col("right_group")))


# ---------------------------------------------------------------- hierarchy
def node_alert_rollup(events: DataFrame) -> DataFrame:
    """Lines, alerts and the sorted distinct alert types per node; types are few by construction."""
    types = F.array_sort(F.collect_set(F.when(F.col("is_alert"), F.col("alert_type"))))
    return events.filter(F.col("rack").isNotNull()).groupBy("node", "rack", "midplane", "node_card").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("is_alert").alias("alerts"),
        F.concat_ws(",", types).alias("alert_types"))


def template_outcomes(events: DataFrame, sessions: DataFrame, train: DataFrame, key: str = "block_id") -> DataFrame:
    """Anomalous and normal training sessions per template; every template is listed."""
    seen = events.join(sessions.select(key).distinct().hint("shuffle_hash"), key, "left_semi").select("event_id", key).distinct()
    marked = seen.join(train.select(key, "is_anomaly").hint("shuffle_hash"), key, "left")
    return marked.groupBy("event_id").agg(
        F.count_if("is_anomaly").alias("anomalous"), F.count_if(~F.col("is_anomaly")).alias("normal"),
    ).withColumn("anomalous_share", F.when(
        F.col("anomalous") + F.col("normal") > 0, F.col("anomalous") / (F.col("anomalous") + F.col("normal"))))
