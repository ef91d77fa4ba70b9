"""Streaming jobs against their batch twins."""

import random

from pyspark.sql import functions as F

from opslattice.operators import timeseries as TS
from opslattice.streaming import jobs


def test_sessions_leave_the_state_and_equal_the_batch_runs(spark, tmp_path):
    rng = random.Random(3)
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    rows, now, open_rows = [], 0, []
    for part in range(4):
        new = [(len(rows) + i, rng.choice(["a", "b", "c", None]), now + rng.randint(0, 40_000)) for i in range(60)]
        rows += new
        now += 40_000
        frame = spark.createDataFrame(new, "event_id int, user_id string, s int").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
        frame.coalesce(1).write.mode("append").parquet(source)
        found = jobs.key_incidents(jobs.stream_table(spark, source), folder, "ts", "user_id", 1800, "1 hour")
        events = spark.createDataFrame(rows, "event_id int, user_id string, s int").withColumn("ts", F.timestamp_seconds("s"))
        runs = TS.key_runs(events, "user_id", "ts", "event_id", 1800).groupBy("key", "run").agg(
            F.min("t").alias("t"), F.count(F.lit(1)).alias("size"))
        expected = {(r["key"], r["t"] // 1_000_000, r["size"]) for r in runs.collect()}
        got = found.select("key", F.unix_timestamp(F.col("first_ts").cast("timestamp")).alias("t"), "size").collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected
        open_rows.append(jobs.open_sessions(spark, folder).count())
    assert len(expected) > 80 and max(open_rows) < 15  # the state does not grow with the stream


def test_a_stream_without_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], "event_id int, user_id string, ts timestamp").write.parquet(source)
    assert jobs.key_incidents(jobs.stream_table(spark, source), str(tmp_path / "job"), "ts", "user_id").collect() == []
