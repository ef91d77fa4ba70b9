"""Log sessions, count vectors and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslattice.functions import parsing as P


def parse_log(raw: DataFrame) -> DataFrame:
    """Structured log lines to typed events; lines without a block keep a null block_id."""
    return raw.select(
        F.col("LineId").cast("int").alias("line_id"),
        P.compose_ts(F.col("Date"), F.col("Time")).alias("ts"),
        F.col("Level").alias("level"),
        F.col("Component").alias("component"),
        F.col("Content").alias("content"),
        F.col("EventId").alias("event_id"),
        F.col("EventTemplate").alias("event_template"),
        P.extract_key(F.col("Content")).alias("block_id"),
    )


def parse_hardware_log(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("LineId").cast("int").alias("line_id"),
        F.col("Label").alias("alert_type"),
        P.derive_alert_flag(F.col("Label")).alias("is_alert"),
        P.epoch_to_ts(F.col("Timestamp")).alias("ts"),
        F.col("Node").alias("node"),
        *P.parse_hierarchy(F.col("Node")),
    )


def session_rollup(
    events: DataFrame, key: str, ts: str, template: str, labels: DataFrame | None = None,
    positive: str = "Anomaly",
) -> DataFrame:
    """One row per key: label, first and last time, lines, distinct templates.

    Events are reduced per key before labels join, so only one row per key is shuffled
    to the join. A doubly labelled key yields one row per label (see the uniqueness gate).
    """
    rolled = events.groupBy(key).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_lines"), F.countDistinct(template).alias("n_distinct_events"),
    )
    if labels is None:
        return rolled
    return rolled.join(labels.select(key, "label").distinct(), key).select(
        key, (F.col("label") == positive).alias("is_anomaly"), "first_ts", "last_ts", "n_lines", "n_distinct_events"
    )


def count_long(events: DataFrame, key: str, template: str) -> DataFrame:
    return events.groupBy(key, template).agg(F.count(F.lit(1)).alias("cnt"))


def count_matrix(long: DataFrame, key: str, template: str, values: list[str]) -> DataFrame:
    """Wide counts with a fixed column per template, 0 where absent."""
    return long.groupBy(key).pivot(template, values).agg(F.sum("cnt")).fillna(0, subset=values)


def sequence_signature(long: DataFrame, key: str, template: str) -> DataFrame:
    """'E11x3 E22x1' per key; the array holds one element per template, not per line."""
    part = F.concat(F.col(template), F.lit("x"), F.col("cnt").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(template).alias("t"), part.alias("s"))))
    return long.groupBy(key).agg(F.concat_ws(" ", F.transform(listed, lambda e: e["s"])).alias("seq"))


def vector_key(wide: DataFrame, values: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(v).cast("string") for v in values])


def modal_vector_ceiling(vectors: DataFrame, label: str, is_test: str, vector: str) -> DataFrame:
    """How many test positives look exactly like the most frequent normal vector."""
    counts = vectors.groupBy(vector).agg(
        F.count_if(~F.col(label)).alias("normal"),
        F.count_if(F.col(label) & F.col(is_test)).alias("test_positive"),
    )
    # every number of the report is a sum or a maximum over the per-vector counts
    best = F.max(F.struct("normal", F.col(vector).alias("v"), F.col("test_positive").alias("same")))
    return counts.agg(
        best.alias("b"), F.sum("normal").alias("normals"), F.sum("test_positive").alias("positives")
    ).select(
        F.col("b.v").alias("modal_vector"), F.col("b.normal").alias("modal_count"),
        (F.col("b.normal") / F.col("normals")).alias("modal_share"),
        F.col("b.same").alias("identical_positives"),
        (1 - F.col("b.same") / F.greatest(F.col("positives"), F.lit(1))).alias("recall_ceiling"),
    )


def etl_statistics(events: DataFrame, sessions: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """Counts and quality indicators of one load as a single row."""
    unlabeled = events.join(sessions.select("block_id").distinct(), "block_id", "left_anti")
    parts = [
        raw_lines.agg(F.count(F.lit(1)).alias("raw_lines")),
        events.agg(F.count(F.lit(1)).alias("lines_with_block"), F.countDistinct("event_id").alias("templates"),
                   F.min("ts").alias("window_start"), F.max("ts").alias("window_end")),
        sessions.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("is_anomaly").alias("anomalous_sessions"),
                     (F.count(F.lit(1)) - F.countDistinct("block_id")).alias("dup_session_rows")),
        unlabeled.agg(F.count(F.lit(1)).alias("unlabeled_lines")),
    ]
    return one_row(parts)


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Put single-row frames side by side through an equi-join on a constant key."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = keyed[0]
    for p in keyed[1:]:
        out = out.join(p, "_one")
    return out.drop("_one")
