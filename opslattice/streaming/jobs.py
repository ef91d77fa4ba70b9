"""Streaming twins of the hourly series and of single-key incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A growing folder (or glob) of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


def stream_hourly_counts(events: DataFrame, ts: str, alert: str, delay: str = "1 hour") -> DataFrame:
    """Flows and alerts per hour; rows later than the watermark are dropped."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", "1 hour")).agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(alert).alias("alerts"),
    ).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "flows", "alerts")


def stream_key_incidents(events: DataFrame, ts: str, key: str, gap_s: int = 1800, delay: str = "1 hour") -> DataFrame:
    """Sessions per key whose neighbours are at most gap_s apart, for append mode.

    A session is returned, and leaves the state, once the watermark has passed its last row by gap_s; so the state holds the
    sessions of the last gap_s and `delay` only. Those still open at the end of a run are in `open_sessions`.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.session_window("_ts", f"{gap_s} seconds"), F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("size"), F.min("_ts").alias("_first"),
    ).select("key", F.col("_first").cast("timestamp_ntz").alias("first_ts"), "size")


def open_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions that the state of a `stream_key_incidents` job in `folder` still holds, read without changing it."""
    # The value holds the session, the grouping key, and the running aggregates under names of Spark's own: one time, one number of rows.
    state = spark.read.format("statestore").load(f"{folder}/state").select("value.*").drop("session_window")
    key, *aggregates = state.schema.fields
    first, = (f.name for f in aggregates if f.dataType.typeName() == "timestamp")
    size, = (f.name for f in aggregates if f.name != first)
    return state.select(F.col(f"`{key.name}`").alias("key"), F.col(f"`{first}`").cast("timestamp_ntz").alias("first_ts"),
                        F.col(f"`{size}`").alias("size"))


def run_available(stream: DataFrame, folder: str, mode: str) -> int:
    """Process what is there, one folder per batch, and return the number of batches; a replayed batch overwrites its own folder."""
    batches = []

    def store(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .foreachBatch(store).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return len(batches)


def key_incidents(events: DataFrame, folder: str, ts: str, key: str, gap_s: int = 1800, delay: str = "1 hour") -> DataFrame:
    """(key, first_ts, size): run the job over what is there, then all sessions of the folder, closed ones and those still open.

    Run it again when more files have come: closed sessions stay as they are, open ones go on. A stream that never had a row has none.
    """
    spark = events.sparkSession
    sessions = stream_key_incidents(events, ts, key, gap_s, delay)
    spark.createDataFrame([], sessions.schema).write.mode("overwrite").parquet(f"{folder}/out/batch=-1")
    ran = run_available(sessions, folder, "append")
    closed = spark.read.parquet(f"{folder}/out").select("key", "first_ts", "size")
    return closed.unionByName(open_sessions(spark, folder)) if ran else closed


def latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The result of an update-mode job: the newest version of every row."""
    rows = spark.read.parquet(f"{folder}/out")
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r", "batch")
