"""Detectors, thresholds and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslattice.catalog.aggregates import LINE_TEMPLATES, RISK, VECTORS, count_vectors, external_flows, risk_scores
from opslattice.catalog.base import Tables, query
from opslattice.catalog.joins import SPLIT, TOUCH, received, split_blocks
from opslattice.catalog.parsing import REPUTATION
from opslattice.catalog.rankings import SEQUENCE, sequences
from opslattice.functions import parsing as P
from opslattice.operators import detection as D
from opslattice.operators import metrics as M
from opslattice.operators import relational as R
from opslattice.operators.metrics import chrono_split
from opslattice.plans.runtime import durable, written
from opslattice.plans.skew import history, split_bursts


def labelled_vectors(t: Tables):
    split = split_blocks(t).select("block_id", "block_no", "is_anomaly", "split")
    return count_vectors(t).join(split, "block_id")


def vectors(t: Tables):
    """Count vectors with label and split, written once because the learners read them several times."""
    return durable(labelled_vectors(t))


@query("d1_rule_detector", f"SELECT block_id, CAST(E7 AS DOUBLE) AS score, E7 > 0 AS flag FROM ({VECTORS}) WHERE split = 'test'")
def _(t):
    test = labelled_vectors(t).filter("split = 'test'")
    columns = [c for c in P.EXCEPTION_TEMPLATES if c in LINE_TEMPLATES]
    return D.rule_detector(test, columns).select("block_id", "score", "flag")


MEASURES = [f"{m}_{c}" for c in LINE_TEMPLATES for m in ("n", "qty", "price")]


def measure_vectors(t: Tables):
    """Lines, quantity and price per template: correlated columns, so that few components carry most variance."""
    lines = t.sql(MEASURED)
    wide = lines.groupBy("block_id").pivot("event_id", LINE_TEMPLATES).agg(
        F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"), F.sum("price").alias("price"))
    named = wide.select("block_id", *[F.coalesce(F.col(f"{c}_{m}").cast("double"), F.lit(0.0)).alias(f"{m}_{c}")
                                      for c in LINE_TEMPLATES for m in ("n", "qty", "price")])
    return durable(named.join(split_blocks(t).select("block_id", "block_no", "is_anomaly", "split"), "block_id"))


MEASURED = """SELECT 'blk_' || CAST(l_orderkey AS STRING) AS block_id, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount >= 0.09 THEN 'E7'
    ELSE CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'E5' WHEN 'AO' THEN 'E22' WHEN 'NF' THEN 'E26' WHEN 'NO' THEN 'E11' WHEN 'RF' THEN 'E9' ELSE 'E21' END END AS event_id,
    CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM @lineitem"""


@query("d2_pca_residual")
def _(t):
    rows = measure_vectors(t)
    train = rows.filter("split = 'train'")
    model = D.fit_pca(train, MEASURES)
    threshold = M.exact_percentile(train.withColumn("s", D.pca_residual(model)), "s", D.PERCENTILE)
    scored = rows.withColumn("score", D.pca_residual(model))
    return scored.select("block_id", "split", F.round("score", 6).alias("score"), (F.col("score") > threshold).alias("flag"))


@query("d3_isolation_forest")
def _(t):
    rows = vectors(t)
    forest = D.fit_isolation_forest(rows.filter("split = 'train'"), LINE_TEMPLATES, "block_no")
    scored = D.score_isolation_forest(rows.filter("split = 'test'"), LINE_TEMPLATES, forest)
    return scored.select("block_id", F.round("score", 6).alias("score"))


@query("d4_logreg_counts")
def _(t):
    rows = vectors(t)
    fitted = D.fit_logreg_counts(rows.filter("split = 'train'"), LINE_TEMPLATES, "is_anomaly")
    scored = D.score_logreg_counts(rows.filter("split = 'test'"), LINE_TEMPLATES, fitted)
    return scored.select("block_id", F.round("score", 6).alias("score"), "flag")


@query("k8_top_feature_weights")
def _(t):
    model, _idf = D.fit_logreg_counts(vectors(t).filter("split = 'train'"), LINE_TEMPLATES, "is_anomaly")
    top = D.top_feature_weights(LINE_TEMPLATES, model.coefficients.toArray().tolist())
    return t.spark.createDataFrame([(n, round(w, 3)) for n, w in top], "feature string, weight double")


@query("d5_detector_protocol")
def _(t):
    rows = measure_vectors(t)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    out = None
    for method, columns in (("events", ["n_E7"]), ("residual", MEASURES), ("isolation", MEASURES)):
        scored = D.AnomalyScorer(method, columns, "block_no").fit(train).transform(test)
        flagged = written(scored.select("is_anomaly", "score", "flag"), "scored")  # the metrics read it several times
        report = M.binary_metrics(flagged, "is_anomaly", "score", "flag").withColumn("detector", F.lit(method))
        out = report if out is None else out.union(report)
    return out


SCORED = "SELECT l_extendedprice AS score, l_returnflag = 'R' AS y, l_extendedprice > 60000 AS flag FROM @lineitem"
METRICS = f"""WITH c AS (SELECT count(*) FILTER (WHERE y AND flag) AS tp, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE y) AS pos FROM ({SCORED})),
    s AS (SELECT score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM ({SCORED}) GROUP BY 1),
    u AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM s)
    SELECT round(tp / flagged, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (flagged + pos), 6) AS f1, flagged,
    (SELECT round(sum(n * (cp - CAST(p AS DOUBLE) / 2)) / (CAST(sum(p) AS DOUBLE) * CAST(sum(n) AS DOUBLE)), 6) FROM u) AS roc_auc,
    (SELECT round(sum(p * CAST(cp AS DOUBLE) / (cp + cn)) / sum(p), 6) FROM u) AS pr_auc FROM c"""


@query("d6_binary_metrics", METRICS)
def _(t):
    rows = t("lineitem").select(F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").alias("y"),
                                (F.col("l_extendedprice") > 60000).alias("flag"))
    return rounded(M.binary_metrics(rows, "y", "score", "flag"))


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


GRID = "(SELECT CAST(round(0.05 * i, 2) AS DOUBLE) AS threshold FROM range(1, 19) r(i))"


def curve_sql(rows: str) -> str:
    return f"""SELECT threshold, tp, flagged, CASE WHEN flagged > 0 THEN round(tp / flagged, 6) ELSE 0 END AS precision,
      CASE WHEN pos > 0 THEN round(tp / pos, 6) ELSE 0 END AS recall, CASE WHEN flagged + pos > 0 THEN round(2 * tp / (flagged + pos), 6) ELSE 0 END AS f1
      FROM (SELECT threshold, count(*) FILTER (WHERE y AND (flag OR score >= threshold)) AS tp, count(*) FILTER (WHERE flag OR score >= threshold) AS flagged,
        count(*) FILTER (WHERE y) AS pos FROM ({rows}), {GRID} GROUP BY 1)"""


@query("d7_train_threshold_by_f1", f"""SELECT * FROM ({curve_sql("SELECT is_anomaly AS y, false AS flag, residual / 6 AS score FROM @blocks")}) ORDER BY f1 DESC, threshold LIMIT 1""")
def _(t):
    curve = M.threshold_curve(t("blocks"), F.col("is_anomaly"), F.col("residual") / 6, D.RISK_GRID)
    return rounded(M.best_threshold(curve))


@query("d7_threshold_curve", curve_sql("SELECT is_anomaly AS y, flag, residual / 6 AS score FROM @blocks"))
def _(t):
    return rounded(M.threshold_curve(t("blocks"), F.col("is_anomaly"), F.col("residual") / 6, D.RISK_GRID, base=F.col("flag")))


@query("d8_neighbour_risk_detector", f"""WITH s AS ({RISK}), b AS (SELECT threshold FROM ({curve_sql("SELECT y, flag, host_risk AS score FROM (" + RISK + ") WHERE split = 'train'")})
      ORDER BY f1 DESC, threshold LIMIT 1)
    SELECT count(*) FILTER (WHERE y AND (flag OR host_risk >= threshold)) AS tp, count(*) FILTER (WHERE flag OR host_risk >= threshold) AS flagged,
    count(*) FILTER (WHERE y) AS positives, count(*) FILTER (WHERE y AND NOT flag AND host_risk >= threshold) AS rescued,
    count(*) FILTER (WHERE NOT y AND NOT flag AND host_risk >= threshold) AS false_added, max(threshold) AS threshold FROM s, b WHERE split = 'test'""")
def _(t):
    scored = durable(risk_scores(t))  # read for the threshold and for the report
    return D.neighbour_risk_report(scored, D.choose_risk_threshold(scored))


SESSION_SPLIT = f"""SELECT session, session % 9 = 0 AS y, CASE WHEN row_number() OVER (ORDER BY first_ts, session) <= CAST(floor(0.7 * count(*) OVER ()) AS BIGINT)
    THEN 'train' ELSE 'test' END AS split FROM (SELECT session, min(ts) AS first_ts FROM ({SEQUENCE}) GROUP BY 1)"""


def session_split(t: Tables):
    first = sequences(t).groupBy("session").agg(F.min("ts").alias("first_ts"))
    return chrono_split(first, "first_ts", "session").withColumn("y", F.col("session") % 9 == 0)


@query("d9_sequence_identity", f"""WITH q AS (SELECT session, list(template ORDER BY ts, line) AS seq FROM ({SEQUENCE}) GROUP BY 1), p AS ({SESSION_SPLIT})
    SELECT session FROM q JOIN p USING (session) WHERE split = 'test' AND y
    AND seq IN (SELECT seq FROM q JOIN p USING (session) WHERE split = 'train' AND NOT y)""")
def _(t):
    prints = D.sequence_fingerprint(sequences(t), "session", "cell", ["ts", "line"], "template")
    split = session_split(t)
    return D.sequence_identity(prints, split.filter("split = 'test' AND y"), split.filter("split = 'train' AND NOT y"), "session")


CONTEXT = 10  # events before the judged one that a context can hold


def context_sql(n: int) -> str:
    return " || ',' || ".join(f"p{i}" for i in range(n, 0, -1))


NEXT_EVENT = f"""WITH e AS (SELECT line, session, CASE WHEN session % 50 = 7 AND template = 'view' THEN 'rare' ELSE template END AS template, ts FROM ({SEQUENCE})),
    h AS (SELECT line, session, template, {', '.join(f"lag(template, {i}) OVER w AS p{i}" for i in range(1, CONTEXT + 1))} FROM e
      WINDOW w AS (PARTITION BY session ORDER BY ts, line)),
    c AS (SELECT line, session, template, unnest(range({CONTEXT + 1})) AS len, unnest(['0|', {', '.join(
      f"CASE WHEN p{n} IS NOT NULL THEN '{n}|' || {context_sql(n)} END" for n in range(1, CONTEXT + 1))}]) AS ctx FROM h),
    tr AS (SELECT * FROM c WHERE ctx IS NOT NULL AND session % 3 <> 0 AND session % 50 <> 7),
    m AS (SELECT ctx, template, count(*) AS cnt, sum(count(*)) OVER (PARTITION BY ctx) AS total, count(*) OVER (PARTITION BY ctx) AS cand,
      rank() OVER (PARTITION BY ctx ORDER BY count(*) DESC) - 1 AS rank FROM tr GROUP BY 1, 2),
    s AS (SELECT line, max(len) AS len FROM c WHERE ctx IN (SELECT ctx FROM m) GROUP BY 1),
    j AS (SELECT c.line, c.session, c.template, c.ctx, m.rank, m.cnt / m.total AS p, (SELECT max(cand) FROM m m2 WHERE m2.ctx = c.ctx) AS cand
      FROM c JOIN s ON c.line = s.line AND c.len = s.len LEFT JOIN m ON m.ctx = c.ctx AND m.template = c.template)
    SELECT session, CAST(max(CASE WHEN template NOT IN (SELECT template FROM tr) THEN 1000000 ELSE coalesce(rank, cand) END) AS BIGINT) AS max_rank,
    round(min(CASE WHEN template NOT IN (SELECT template FROM tr) THEN 0 ELSE coalesce(p, 0) END), 6) AS min_p FROM j GROUP BY 1"""


def rare_sequences(t: Tables):
    rare = F.when((F.col("session") % 50 == 7) & (F.col("template") == "view"), "rare").otherwise(F.col("template"))
    cut = split_bursts(sequences(t).withColumn("template", rare), ["session"], "cell", ["ts", "line"])
    listed = history(cut, ["session"], "cell", ["ts", "line"], "template", CONTEXT)
    return durable(listed)  # training and scoring both read it


@query("d10_next_event_scores", NEXT_EVENT)
def _(t):
    listed = rare_sequences(t)
    train = listed.filter("session % 3 <> 0 AND session % 50 <> 7")
    scores = D.next_event_scores(train, listed, "session", "line", "template")
    return scores.select("session", F.col("max_rank").cast("bigint").alias("max_rank"), F.round("min_p", 6).alias("min_p"))


@query("d10_next_event_detector")
def _(t):
    listed, split = rare_sequences(t), session_split(t)
    cut = M.split_point(split.filter("split = 'train'"), "first_ts", "session", lambda n: int(n * 0.8))
    parts = split.withColumn("part", F.when(F.col("split") == "test", "test").when(
        M.before_split(F.col("first_ts"), F.col("session"), cut), "fit").otherwise("validation"))
    return D.next_event_detector(listed, parts, "session", "line", "template")


@query("d11_detector_overlap", """SELECT count(*) FILTER (WHERE y AND a) AS caught_a, count(*) FILTER (WHERE y AND b) AS caught_b, count(*) FILTER (WHERE y AND a AND b) AS caught_both,
    count(*) FILTER (WHERE y AND (a OR b)) AS caught_any, count(*) FILTER (WHERE NOT y AND a) AS false_a, count(*) FILTER (WHERE NOT y AND b) AS false_b,
    count(*) FILTER (WHERE a OR b) AS flagged_any, count(*) FILTER (WHERE y) AS positives, round(count(*) FILTER (WHERE y AND (a OR b)) / count(*) FILTER (WHERE a OR b), 6) AS precision,
    round(count(*) FILTER (WHERE y AND (a OR b)) / count(*) FILTER (WHERE y), 6) AS recall,
    round(2 * count(*) FILTER (WHERE y AND (a OR b)) / (count(*) FILTER (WHERE a OR b) + count(*) FILTER (WHERE y)), 6) AS f1
    FROM (SELECT is_anomaly AS y, flag AS a, residual < 0.5 AS b FROM @blocks)""")
def _(t):
    rows = t("blocks").select(F.col("is_anomaly").alias("y"), F.col("flag").alias("a"), (F.col("residual") < 0.5).alias("b"))
    return rounded(M.detector_overlap(rows, "y", "a", "b"))


HOTSPOTS = f"""WITH h AS (SELECT host, count(*) AS blocks, count(*) FILTER (WHERE is_anomaly) AS anomalous FROM ({TOUCH}) x JOIN @order_labels USING (block_no) GROUP BY 1),
    b AS (SELECT avg(CAST(is_anomaly AS INT)) AS p FROM @order_labels), m AS (SELECT count(*) AS m FROM h),
    k AS (SELECT host, blocks, anomalous, unnest(range(anomalous, blocks + 1)) AS i FROM h),
    t AS (SELECT host, blocks, anomalous, sum(exp(lgamma(CAST(blocks + 1 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(blocks - i + 1 AS DOUBLE))
      + i * ln(p) + (blocks - i) * ln(1 - p))) AS p_value FROM k, b GROUP BY 1, 2, 3)
    SELECT host, blocks, anomalous, round(anomalous / blocks, 6) AS rate, round(p_value, 8) AS p_value, p_value < CAST(0.05 AS DOUBLE) / m AS significant FROM t, m"""


def hotspots(t: Tables):
    touch = R.union_distinct(t("placement").select("host", "block_no"), received(t).select("host", "block_no"))
    return D.binomial_hotspots(touch, t("order_labels"), "host", "block_no")


@query("d12_binomial_hotspots", HOTSPOTS)
def _(t):
    return hotspots(t).withColumn("rate", F.round("rate", 6)).withColumn("p_value", F.round("p_value", 8))


FLAG = "CAST({} AS INT)"
FEATURES = f"""SELECT flow_id, dest_port, src_port, CAST(dest_port IN (22, 23, 445, 1433, 3389, 2375, 5900) AS INT) AS sensitive_port,
    CAST(proto = 'TCP' AS INT) AS tcp, pkts_toserver, pkts_toclient, bytes_toserver, bytes_toclient,
    round((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 6) AS duration_s, CAST(pkts_toclient = 0 AS INT) AS no_reply,
    {', '.join(f"CAST(state = '{s}' AS INT) AS state_{s}" for s in ('new', 'established', 'closed'))},
    {', '.join(f"CAST(app_proto = '{a}' AS INT) AS app_{a}" for a in ('failed', 'http', 'dns'))} FROM @flows"""


@query("d13_flow_features", FEATURES)
def _(t):
    return D.flow_features(t("flows"), "flow_id").withColumn("duration_s", F.round("duration_s", 6))


def triage_features(t: Tables):
    return D.flow_features(external_flows(t), "flow_id", "start_ts", "alerted")


@query("d14_triage_rule", f"""WITH f AS (SELECT flow_id, start_ts, alerted, dest_port, pkts_toserver FROM @flows WHERE NOT (src_ip LIKE '192.168.%' OR src_ip LIKE '10.%' OR src_ip LIKE '172.16.%')),
    r AS (SELECT *, row_number() OVER (ORDER BY start_ts, flow_id) AS r, count(*) OVER () AS n FROM f)
    SELECT flow_id, round(CAST(dest_port IN (22, 23, 445, 1433, 3389, 2375, 5900) AS INT) + CAST(1e-9 AS DOUBLE) * pkts_toserver, 9) AS score,
    dest_port IN (22, 23, 445, 1433, 3389, 2375, 5900) AS flag, alerted FROM r WHERE r > CAST(floor(0.7 * n) AS BIGINT)""")
def _(t):
    test = chrono_split(triage_features(t), "start_ts", "flow_id").filter("split = 'test'")
    return D.rule_triage(test).select("flow_id", F.round("score", 9).alias("score"), "flag", "alerted")


@query("d14_triage_logistic")
def _(t):
    rows = chrono_split(triage_features(t), "start_ts", "flow_id")
    scored = D.logistic_triage(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "alerted")
    return scored.select("flow_id", "alerted", F.round("score", 6).alias("score"), "flag")


@query("d14_triage_model")
def _(t):
    scored = D.boosted_triage(durable(triage_features(t)), "start_ts", "flow_id", "alerted")
    return scored.select("flow_id", "alerted", F.round("score", 6).alias("score"), "flag", "threshold")


TRIAGED = "SELECT flow_id, alerted, dest_port < 1000 AS flag FROM @flows"


def triaged(t: Tables):
    return t("flows").select("flow_id", "alerted", (F.col("dest_port") < 1000).alias("flag"))


@query("d15_miss_analysis", f"""SELECT coalesce(category, 'no linked alert record') AS category, count(*) AS n FROM ({TRIAGED}) f LEFT JOIN
    (SELECT flow_id, min(category) AS category FROM @alerts GROUP BY 1) a ON a.flow_id = f.flow_id WHERE alerted AND NOT flag GROUP BY 1""")
def _(t):
    return D.miss_analysis(triaged(t), t("alerts"))


@query("d15_recall_by_reputation", f"""SELECT round(avg(CAST(rep AS INT)), 6) AS reputation_share, round(avg(CAST(flag AS INT)) FILTER (WHERE rep), 6) AS recall_reputation,
    round(avg(CAST(flag AS INT)) FILTER (WHERE NOT rep), 6) AS recall_behavioural FROM
    (SELECT flag, flow_id IN (SELECT flow_id FROM @alerts WHERE {REPUTATION}) AS rep FROM ({TRIAGED}) WHERE alerted)""")
def _(t):
    return rounded(D.recall_by_reputation(triaged(t), t("alerts"), P.is_reputation_signature(F.col("signature"))))
