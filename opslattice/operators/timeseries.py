"""Hourly series, burst detection and incident correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslattice.functions.parsing import micros
from opslattice.operators.graph import connected_components
from opslattice.plans.skew import HOT_ROWS, last_seen, previous, salted_join, split_bursts, totalled


def hour_of(ts: str):
    return F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz")


def hourly_counts(flows: DataFrame, alerts: DataFrame, flow_ts: str, alert_ts: str) -> DataFrame:
    """Flows and alerts per hour; an hour with neither is absent."""
    f = flows.groupBy(hour_of(flow_ts).alias("hour")).agg(F.count(F.lit(1)).alias("flows"))
    a = alerts.groupBy(hour_of(alert_ts).alias("hour")).agg(F.count(F.lit(1)).alias("alerts"))
    zero = F.lit(0).cast("bigint")
    return f.join(a, "hour", "full").select(
        "hour", F.coalesce("flows", zero).alias("flows"), F.coalesce("alerts", zero).alias("alerts"))


def robust_z_burst(series: DataFrame, column: str, z: float = 3.5) -> DataFrame:
    """0.6745 (x - median) / MAD per hour, burst when above z; a MAD of 0 counts as 1.

    The series has one row per hour, so both medians are over a small table.
    """
    one = F.lit(1).alias("_one")
    med = series.agg(F.median(column).alias("_med"), one)
    keyed = series.withColumn("_one", F.lit(1)).join(F.broadcast(med), "_one")
    mad = keyed.agg(F.median(F.abs(F.col(column) - F.col("_med"))).alias("_mad"), one)
    scored = keyed.join(F.broadcast(mad), "_one").withColumn(
        "robust_z", 0.6745 * (F.col(column) - F.col("_med")) / F.when(F.col("_mad") == 0, 1.0).otherwise(F.col("_mad")))
    return scored.select(*series.columns, "robust_z", (F.col("robust_z") > z).alias("burst"))


def _timed(events: DataFrame, key: str, ts: str, id_col: str, bucket_s: int) -> DataFrame:
    return events.select(
        F.col(id_col).alias("id"), F.col(key).alias("key"), micros(F.col(ts)).alias("t")
    ).withColumn("bucket", F.floor(F.col("t") / (bucket_s * 1_000_000)))


def gap_to_previous(events: DataFrame, key: str, ts: str, id_col: str, bucket_s: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, key, t, bucket, prev_id, gap_us) by (time, id) within each key; bursts inside a bucket are split."""
    timed = split_bursts(_timed(events, key, ts, id_col, bucket_s), ["key"], "bucket", ["t", "id"], hot_rows)
    linked = previous(timed, ["key"], "bucket", ["t", "id"], ["t", "id"])
    return linked.select("id", "key", "t", "bucket", F.col("prev.id").alias("prev_id"),
                         (F.col("t") - F.col("prev.t")).alias("gap_us"))


def key_runs(events: DataFrame, key: str, ts: str, id_col: str, window_s: int, bucket_s: int = 3600,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, key, t, run): run is the id of the first event of its gap-free stretch."""
    gaps = gap_to_previous(events, key, ts, id_col, bucket_s, hot_rows)
    starts = F.col("gap_us").isNull() | (F.col("gap_us") > window_s * 1_000_000)
    flagged = gaps.withColumn("_start", F.when(starts, F.col("id")))
    return last_seen(flagged, ["key"], "bucket", ["t", "id"], "_start", "run").select("id", "key", "t", "run")


def correlate_incidents(events: DataFrame, id_col: str, ts: str, keys: list[str], window_s: int = 1800,
                        bucket_s: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, incident): events joined through any key with a gap of at most window_s.

    Per key every event points at the first event of its run, so a long run is a star
    and not a chain before components are merged over all keys.
    """
    runs = [key_runs(events, k, ts, id_col, window_s, bucket_s, hot_rows).filter(F.col("id") != F.col("run"))
            .select(F.col("id").alias("src"), F.col("run").alias("dst")) for k in keys]
    edges = reduce(DataFrame.union, runs)
    parts = connected_components(edges, vertices=events.select(F.col(id_col).alias("id")), hot_rows=hot_rows)
    return parts.withColumnRenamed("component", "incident")


def links_in_window(events: DataFrame, id_col: str, ts: str, keys: list[str], window_s: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(src, dst): every two events, the earlier one first by (time, id), that share one of the keys and are at most window_s apart.

    Time is cut into cells of the window's length, so partners are in the same cell or the one before. Each later event looks at both
    cells; a crowded (key, cell) is spread by the earlier event, to whose salts the later events are copied. Pairs that several keys link are
    listed once. The result grows with the square of a burst, as it is the list of its pairs; `partners_in_window` counts them instead.
    """
    w = window_s * 1_000_000
    out = []
    for key in keys:
        timed = _timed(events, key, ts, id_col, window_s).filter(F.col("key").isNotNull())
        earlier = timed.select("key", F.col("bucket").alias("cell"), F.col("id").alias("src"), F.col("t").alias("_t"))
        later = timed.select("key", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("cell"), F.col("id").alias("dst"), "t")
        met = salted_join(earlier, later, ["key", "cell"], "src", hot_rows=hot_rows)
        before = (F.col("_t") < F.col("t")) | ((F.col("_t") == F.col("t")) & (F.col("src") < F.col("dst")))
        out.append(met.filter(before & (F.col("t") - F.col("_t") <= w)).select("src", "dst"))
    links = reduce(DataFrame.union, out)
    return links if len(keys) == 1 else links.distinct()


def partners_in_window(events: DataFrame, key: str, ts: str, id_col: str, window_s: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, partners): earlier events of the same key at most window_s old, by (time, id).

    Counts the links that `links_in_window` would list, without listing them. An event has as many partners as its position within the
    key exceeds that of the last event too old for it, and positions are found bucket by bucket, bursts split.
    """
    w = window_s * 1_000_000
    timed = _timed(events, key, ts, id_col, window_s)
    # Each event is there once as itself and once as the border of its window, just before all events of that time.
    rows = timed.select("id", "key", "t", F.lit(1).alias("_one")).unionByName(
        timed.select("id", "key", (F.col("t") - w).alias("t"), F.lit(0).alias("_one")))
    rows = rows.withColumn("bucket", F.floor(F.col("t") / w))
    pieces = split_bursts(rows, ["key"], "bucket", ["t", "_one", "id"], hot_rows)
    counted = totalled(pieces, ["key"], "bucket", ["t", "_one", "id"], "_one", "_upto")
    return counted.groupBy("id").agg(
        (F.max(F.when(F.col("_one") == 1, F.col("_upto"))) - F.max(F.when(F.col("_one") == 0, F.col("_upto"))) - 1).alias("partners"))


def incident_stats(incidents: DataFrame, incident: str = "incident") -> DataFrame:
    sizes = incidents.groupBy(incident).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.sum("size").alias("events"), F.count(F.lit(1)).alias("incidents"),
        F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"))
