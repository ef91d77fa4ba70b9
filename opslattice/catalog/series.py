"""Time series, incidents and their streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opslattice.catalog.base import Tables, query
from opslattice.operators import timeseries as TSR
from opslattice.plans.runtime import shared_dir
from opslattice.streaming import jobs

HOURLY = """SELECT coalesce(f.h, a.h) AS hour, coalesce(flows, 0) AS flows, coalesce(alerts, 0) AS alerts FROM
    (SELECT date_trunc('hour', start_ts) AS h, count(*) AS flows FROM @flows GROUP BY 1) f FULL JOIN
    (SELECT date_trunc('hour', alert_ts) AS h, count(*) AS alerts FROM @alerts GROUP BY 1) a ON f.h = a.h"""


def hourly(t: Tables):
    return TSR.hourly_counts(t("flows"), t("alerts"), "start_ts", "alert_ts")


@query("t1_hourly_counts", HOURLY)
def _(t):
    return hourly(t)


@query("t2_robust_z_burst", f"""WITH s AS ({HOURLY}), m AS (SELECT median(alerts) AS med FROM s), d AS (SELECT median(abs(alerts - med)) AS mad FROM s, m)
    SELECT hour, flows, alerts, round(z, 6) AS robust_z, z > 3.5 AS burst FROM (SELECT s.*, CAST(0.6745 AS DOUBLE) * (alerts - med) / CASE WHEN mad = 0 THEN 1 ELSE mad END AS z FROM s, m, d)""")
def _(t):
    return TSR.robust_z_burst(hourly(t), "alerts").withColumn("robust_z", F.round("robust_z", 6))


# one label per event and round: labels spread along same-key links until nothing changes
INCIDENTS = """WITH RECURSIVE a AS MATERIALIZED (SELECT flow_id AS id, alert_ts AS ts, src_ip, signature_id FROM @alerts),
    n AS MATERIALIZED (SELECT id, lead(id) OVER w1 AS nx, lead(ts) OVER w1 - ts AS gap FROM a WINDOW w1 AS (PARTITION BY src_ip ORDER BY ts, id)
      UNION ALL SELECT id, lead(id) OVER w2, lead(ts) OVER w2 - ts FROM a WINDOW w2 AS (PARTITION BY signature_id ORDER BY ts, id)),
    e AS MATERIALIZED (SELECT id AS s, nx AS d FROM n WHERE gap <= INTERVAL '{w}' SECOND UNION ALL SELECT nx, id FROM n WHERE gap <= INTERVAL '{w}' SECOND),
    c(id, r) AS (SELECT id, id FROM a UNION SELECT e.d, c.r FROM c JOIN e ON e.s = c.id)
    SELECT id, min(r) AS incident FROM c GROUP BY 1"""


def incidents(t: Tables):
    return TSR.correlate_incidents(t("alerts"), "flow_id", "alert_ts", ["src_ip", "signature_id"], 1800)


@query("t3_correlate_incidents", INCIDENTS.replace("{w}", "1800"))
def _(t):
    return incidents(t)


@query("t4_incident_stats", f"""SELECT CAST(sum(size) AS BIGINT) AS events, count(*) AS incidents, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS singletons FROM
    (SELECT incident, count(*) AS size FROM ({INCIDENTS.replace("{w}", "1800")}) GROUP BY 1)""")
def _(t):
    return TSR.incident_stats(incidents(t))


RUNS = """SELECT key, min(ts) AS first_ts, count(*) AS size FROM (SELECT key, ts, sum(s) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM
    (SELECT user_id AS key, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '1800' SECOND THEN 0 ELSE 1 END AS s FROM @events))
    GROUP BY key, run"""


@query("t3_single_key_runs", RUNS)
def _(t):
    runs = TSR.key_runs(t("events"), "user_id", "ts", "event_id", 1800)
    return runs.groupBy("key", "run").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("size")).select(
        "key", F.timestamp_micros("t").cast("timestamp_ntz").alias("first_ts"), "size")


def stream_folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("r1_stream_hourly_counts", """SELECT date_trunc('hour', ts) AS hour, count(*) AS flows, count(*) FILTER (WHERE event_type = 'error') AS alerts FROM @events GROUP BY 1""")
def _(t):
    folder = stream_folder(t, "hourly")
    events = jobs.stream_table(t.spark, f"{t.folder}/events*.parquet")
    jobs.run_available(jobs.stream_hourly_counts(events, "ts", F.col("event_type") == "error"), folder, "update")
    return jobs.latest(t.spark, folder, ["hour"])


@query("r2_stream_key_incidents", RUNS)
def _(t):
    folder = stream_folder(t, "incidents")
    events = jobs.stream_table(t.spark, f"{t.folder}/events*.parquet")
    return jobs.key_incidents(events, folder, "ts", "user_id")
