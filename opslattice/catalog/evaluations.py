"""Answer evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslattice.catalog.aggregates import external_flows, rack_alerts
from opslattice.catalog.base import Tables, query
from opslattice.catalog.detectors import rounded
from opslattice.catalog.joins import split_blocks
from opslattice.catalog.reports import host_table
from opslattice.operators import evaluation as E
from opslattice.operators import relational as R
from opslattice.plans.runtime import durable

LINE = r"trim(split_part(trim(answer, E' \t\n\r'), E'\n', 1), E' \t\r')"
NO = r"no anomal(y|ies) (was |were )?(detected|found)"
JUDGED = rf"""SELECT *, CASE WHEN contains(answer, 'blocked by our content filters') THEN false
      WHEN type = 'block' THEN p = CAST(truth AS INT)
      WHEN type = 'host' THEN contains(answer, '10.0.0.1') AND contains(answer, '10.0.0.2')
      WHEN type = 'host_one' THEN (regexp_matches(low, 'risky|high|elevated|significant') AND NOT regexp_matches(low, '\blow\b|not (considered )?risky|not (statistically )?(significant|elevated)')) = (truth = 'true')
      WHEN type = 'source' THEN CASE WHEN regexp_extract(low, '^(\**verdict:?\**\s*)?(yes|no)\b', 2) <> '' THEN regexp_extract(low, '^(\**verdict:?\**\s*)?(yes|no)\b', 2) = 'yes'
        ELSE regexp_matches(low, 'malicious|flagged|worry') AND NOT regexp_matches(low, 'no need to worry|should not worry|not malicious|no alerts|no evidence|no indication|not flagged|no (immediate |specific )?concern') END = (truth = 'true')
      WHEN type IN ('rack', 'scanner') THEN contains(line, truth)
      WHEN type IN ('template', 'signature') THEN contains(answer, truth)
      WHEN type = 'missing' THEN regexp_matches(answer, '(?i)not found|does not|doesn''t|no (record|data|log)|not present') ELSE false END AS ok,
      CASE WHEN type = 'block' AND NOT contains(answer, 'blocked by our content filters') THEN p END AS pred FROM (
    SELECT *, CASE WHEN regexp_matches(low, 'anomal|not healthy|failed (due|because)') AND NOT regexp_matches(low, 'not anomal|{NO}')
        AND NOT ((regexp_matches(low, 'not anomal|is normal|likely normal|\bnormal\b|is healthy|yes, .* is healthy') OR regexp_matches(low, '{NO}')) AND NOT contains(low, 'not healthy')) THEN 1 ELSE 0 END AS p
    FROM (SELECT *, {LINE} AS line, lower({LINE}) AS low FROM @answers JOIN @prompts USING (i)))"""
IDS = r"list_distinct(regexp_extract_all(answer, 'blk_-?[0-9]+|\b[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\b|\bE[0-9]{1,2}\b|\bR[0-9]{2}\b|\b2[0-9]{6}\b'))"
GROUNDED = f"""SELECT *, len(ids) AS n_ids, coalesce(array_to_string(list_sort(list_filter(ids, lambda x: NOT contains(prompt, x))), ' '), '') AS hallucinated FROM (SELECT *, {IDS} AS ids FROM ({JUDGED}))"""


def judged(t: Tables):
    return E.judge_answers(t("answers"), t("prompts")).select("*", *E.ground_ids(F.col("answer"), F.col("prompt")))


@query("e1_golden_set")
def _(t):
    test = split_blocks(t).filter("split = 'test'").select("block_id", "is_anomaly")
    alerted = t("alerts").select("src_ip").dropna().distinct()
    flows = external_flows(t)
    clean = flows.select("src_ip").distinct().join(alerted, "src_ip", "left_anti")
    return E.golden_questions(test, durable(host_table(t)), rack_alerts(t), alerted, clean, R.fan_out(flows))


TEMPLATE_ROWS = """SELECT i, run, answer, type, CASE WHEN type = 'host' THEN '["10.0.0.1"]' ELSE truth END AS truth FROM @answers JOIN @prompts USING (i)"""


@query("e2_score_template_answer", rf"""SELECT i, run, coalesce(CASE WHEN type = 'block' THEN CASE WHEN contains(low, 'anomal') AND NOT regexp_matches(low, '\bnormal\b|healthy') THEN 1 ELSE 0 END = CAST(truth AS INT)
      WHEN type = 'host' THEN list_distinct(regexp_extract_all(answer, '\[([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\][^\n]*\(significant\)', 1)) = ['10.0.0.1']
      WHEN type = 'host_one' THEN contains(answer, '(significant)') = (truth = 'true')
      WHEN type IN ('rack', 'scanner') THEN contains(split_part(answer, E'\n', 1), '[' || truth || ']')
      WHEN type = 'source' THEN contains(split_part(answer, E'\n', 1), 'FLAGGED') = (truth = 'true')
      WHEN type IN ('template', 'signature') THEN i % 2 = 0
      WHEN type = 'missing' THEN contains(answer, 'does not appear') OR contains(answer, 'not contain') END, false) AS ok FROM (SELECT *, lower({LINE}) AS low FROM ({TEMPLATE_ROWS}))""")
def _(t):
    rows = t.sql(TEMPLATE_ROWS)
    retrieved = F.when(F.col("i") % 2 == 0, F.array(F.lit("template:E7"), F.lit("signature:2010935"))).otherwise(F.array().cast("array<string>"))
    ok, _pred = E.template_score(F.col("type"), F.col("truth"), F.col("answer"), retrieved)
    return rows.select("i", "run", ok.alias("ok"))


@query("e3_judge_answer", f"SELECT i, run, type, ok, coalesce(CAST(pred AS VARCHAR), 'none') AS pred FROM ({JUDGED})")
def _(t):
    return E.judge_answers(t("answers"), t("prompts")).select(
        "i", "run", "type", "ok", F.coalesce(F.col("pred").cast("string"), F.lit("none")).alias("pred"))


@query("e4_grounding_check", rf"""SELECT i, run, n_ids, hallucinated, len(c) AS n_citations, coalesce(array_to_string(list_filter(c, lambda x: NOT contains(prompt, x)), ' '), '') AS ungrounded
    FROM (SELECT *, regexp_extract_all(answer, '\[([^\]]+)\]', 1) AS c FROM ({GROUNDED}))""")
def _(t):
    rows = t("answers").join(t("prompts"), "i")
    return rows.select("i", "run", *E.ground_ids(F.col("answer"), F.col("prompt")), *E.ground_citations(F.col("answer"), F.col("prompt")))


@query("e5_eval_summary", f"""SELECT run, count(*) AS n_items, count(*) FILTER (WHERE ok) AS correct, round(avg(CAST(ok AS INT)), 6) AS accuracy,
    round(count(*) FILTER (WHERE pred = 1 AND truth = '1') / greatest(count(*) FILTER (WHERE pred = 1), 1), 6) AS block_precision,
    round(count(*) FILTER (WHERE pred = 1 AND truth = '1') / greatest(count(*) FILTER (WHERE type = 'block' AND truth = '1'), 1), 6) AS block_recall,
    count(*) FILTER (WHERE contains(answer, 'blocked by our content filters')) AS content_filtered, CAST(sum(n_ids) AS BIGINT) AS ids_cited,
    CAST(sum(CASE WHEN hallucinated = '' THEN 0 ELSE len(string_split(hallucinated, ' ')) END) AS BIGINT) AS hallucinated_ids,
    count(*) FILTER (WHERE hallucinated <> '') AS answers_with_hallucinated_id FROM ({GROUNDED}) GROUP BY 1""")
def _(t):
    return rounded(E.eval_summary(judged(t), ["run"]))


@query("e6_ab_compare", f"""SELECT run, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok AND half = 'A') AS half_a,
    count(*) FILTER (WHERE ok AND half = 'B') AS half_b, count(*) FILTER (WHERE contains(answer, 'blocked by our content filters')) AS content_filtered,
    count(*) FILTER (WHERE ok AND NOT contains(answer, 'blocked by our content filters')) AS kept_correct,
    count(*) FILTER (WHERE NOT contains(answer, 'blocked by our content filters')) AS kept,
    count(*) FILTER (WHERE contains(answer, 'blk_123') AND NOT contains(answer, 'blk_1234567890123')) AS example_copies
    FROM ({JUDGED}) JOIN (SELECT i, CASE WHEN row_number() OVER (ORDER BY i) % 2 = 1 THEN 'A' ELSE 'B' END AS half FROM @prompts) h USING (i) GROUP BY 1""")
def _(t):
    return E.ab_compare(E.judge_answers(t("answers"), t("prompts")), E.half_split(t("prompts").select("i"), "i"))


@query("e7_rescore_diff", f"""SELECT i, string_agg(run, ',' ORDER BY run) FILTER (WHERE ok) AS right_runs, string_agg(run, ',' ORDER BY run) FILTER (WHERE NOT ok) AS wrong_runs
    FROM ({JUDGED}) GROUP BY 1 HAVING bool_or(ok) AND NOT bool_and(ok)""")
def _(t):
    return E.rescore_diff(E.judge_answers(t("answers"), t("prompts")))


# Two versions of the judge: the second reads denials, and asks sources for a clear word.
VERSIONS = [
    ("v1", "block", "anomal|not healthy|failed", None, "1"), ("v1", "host_one", "risky|high|elevated", None, "true"),
    ("v1", "source", "malicious|flagged|worry", None, "true"), ("v1", "rack", "{truth}", None, None),
    ("v1", "template", "{truth}", None, None), ("v1", "missing", "not found", None, "not found"),
    ("v2", "block", "anomal|not healthy|failed", "not anomal|no anomal|normal", "1"), ("v2", "host_one", "risky|high|elevated", "low|not ", "true"),
    ("v2", "source", "yes|malicious", "not malicious|no need", "true"), ("v2", "rack", "{truth}", None, None),
    ("v2", "template", "{truth}", None, None), ("v2", "missing", "not found|does not|no (record|data|log)", None, "not found"),
    ("v2", "signature", "{truth}", None, None),
]


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else f"'{value}'"


VERSIONED = f"""SELECT version, run, i, a.type, CASE WHEN must IS NULL AND must_not IS NULL THEN false WHEN must = '{{truth}}' THEN contains(answer, truth)
      ELSE ((must IS NULL OR regexp_matches(lower({LINE}), must)) AND NOT (must_not IS NOT NULL AND regexp_matches(lower({LINE}), must_not)))
        = coalesce(truth = truth_when_met, false) END AS ok
    FROM (SELECT * FROM (SELECT * FROM @answers JOIN @prompts USING (i)), (SELECT 'v1' AS version UNION ALL SELECT 'v2')) a
    LEFT JOIN (VALUES {", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in VERSIONS)}) r(version, type, must, must_not, truth_when_met) USING (version, type)"""


def versioned(t: Tables):
    return E.judge_versions(t("answers"), t("prompts"), t.spark.createDataFrame(VERSIONS, E.RULES))


@query("e7_judge_version_flips", f"""SELECT run, i, type, bool_or(ok) FILTER (WHERE version = 'v1') AS was, bool_or(ok) FILTER (WHERE version = 'v2') AS is_now
    FROM ({VERSIONED}) GROUP BY 1, 2, 3 HAVING was <> is_now""")
def _(t):
    return E.version_flips(versioned(t), "v1", "v2")


@query("e7_judge_version_accuracy", f"""SELECT version, run, count(*) AS n, count(*) FILTER (WHERE ok) AS correct,
    round(count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 6) AS accuracy FROM ({VERSIONED}) GROUP BY 1, 2""")
def _(t):
    return E.version_accuracy(versioned(t))
