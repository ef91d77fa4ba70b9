"""Audits on a hand-made snapshot, judge branches, gates, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from opslattice.catalog import QUERIES
from opslattice.operators import audit as N
from opslattice.operators import evaluation as E
from opslattice.operators import quality as Q
from opslattice.operators.relational import not_in, range_join
from opslattice.sources import readers, writers

RULE = {"proto": "tcp", "from": 22, "to": 22, "cidrs": ["0.0.0.0/0"], "sg_refs": [], "prefix_lists": []}
SNAPSHOT = {
    "captured": "2024-01-01",
    "regions": [{
        "region": "r1", "vpcs": [{"default": True}],
        "security_groups": [
            {"id": "sg-a", "name": "web", "rules": [RULE]},
            {"id": "sg-internal", "name": "internal", "rules": [{**RULE, "from": 8000, "to": 8000, "cidrs": []}]},
            {"id": "sg-old", "name": "old", "rules": []},
            {"id": "sg-d", "name": "default", "rules": []},
        ],
        "enis": [{"id": "e1", "type": "interface", "public_ip": True, "sgs": ["sg-a"]},
                 {"id": "e2", "type": "interface", "public_ip": True, "sgs": ["sg-internal"]},
                 {"id": "e3", "type": "interface", "public_ip": True, "sgs": []}],
        "load_balancers": [{"name": "lb", "scheme": "internet-facing", "listeners": [{"protocol": "HTTP", "port": 80}]},
                           {"name": "safe", "scheme": "internet-facing", "listeners": [{"protocol": "HTTP", "port": 80}, {"protocol": "HTTPS", "port": 443}]}],
    }],
}


def test_snapshot_audit(spark, tmp_path):
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps(SNAPSHOT, indent=1))
    flat = readers.read_config_snapshot(spark, str(path))
    probed = spark.createDataFrame([(22, 5, 3, 2), (3389, 4, 2, 2), (8000, 1, 1, 1)], "dest_port int, flows long, alerted long, sources long")
    found = N.audit_config(flat["groups"], flat["rules"], flat["interfaces"], flat["listeners"], probed)
    rows = {(r["check"], r["sg"] or r["eni"] or r["load_balancer"]): r for r in found.collect()}
    assert set(rows) == {
        ("internet_exposed_rule", "web (sg-a)"), ("probed_port_exposed", "web (sg-a)"), ("plaintext_listener", "lb"),
        ("unneeded_public_ip", "e2"), ("unneeded_public_ip", "e3"), ("unattached_sg", "old (sg-old)"),
    }
    assert rows[("internet_exposed_rule", "web (sg-a)")]["attached"] is True
    assert rows[("internet_exposed_rule", "web (sg-a)")]["ports"] == "tcp 22-22"
    top = N.exposed_top_ports(found, probed)
    assert [r["dest_port"] for r in top.filter("exposed").collect()] == [22]


def test_range_join_equals_brute_force(spark):
    rules = [(0, 0, 65535), (1, 250, 260), (2, 256, 256), (3, 9, 3)]
    ports = [0, 5, 255, 256, 257, 511, 512, 65535]
    r = spark.createDataFrame(rules, "rule int, lo int, hi int")
    p = spark.createDataFrame([(x,) for x in ports], "port int")
    got = sorted((x["rule"], x["port"]) for x in range_join(r, p, "lo", "hi", "port").collect())
    assert got == sorted((i, x) for i, lo, hi in rules for x in ports if lo <= x <= hi)


@pytest.mark.parametrize("others,expected", [([("a",)], ["b"]), ([("a",), (None,)], []), ([], ["a", "b", None])])
def test_not_in_follows_sql(spark, others, expected):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = [r["k"] for r in not_in(rows, spark.createDataFrame(others, "k string"), "k").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


CASES = [
    ("block", "0", "No anomaly was detected in blk_1", True, 0), ("block", "1", "The block is anomalous", True, 1),
    ("block", "1", "\n\n  Block is not healthy\nnormal", True, 1), ("block", "0", "It is not anomalous", True, 0),
    ("block", "1", "failed because of a write error", True, 1), ("block", "1", "Yes, blk_1 is healthy", False, 0),
    ("block", "1", "Sorry, blocked by our content filters", False, None),
    ("host", '["1.1.1.1"]', "see 1.1.1.1 and 2.2.2.2", True, None), ("host", '["1.1.1.1","3.3.3.3"]', "see 1.1.1.1", False, None),
    ("host_one", "true", "risk is high", True, None), ("host_one", "false", "not statistically significant", True, None),
    ("source", "false", "No, there is no evidence of traffic that is malicious", True, None),
    ("source", "true", "Verdict: yes", True, None), ("source", "false", "no need to worry", True, None),
    ("source", "true", "Verdict: source was FLAGGED by the IDS", True, None),
    ("rack", "R30", "R30 leads\nR31", True, None), ("scanner", "9.9.9.9", "first\n9.9.9.9", False, None),
    ("template", "E7", "line\nE7", True, None), ("signature", "2010935", "nothing", False, None),
    ("missing", "not found", "This does not exist", True, None), ("other", "x", "x", False, None),
]


def test_judge(spark):
    answers = spark.createDataFrame([(i, "v1", a) for i, (_, _, a, _, _) in enumerate(CASES)], "i int, run string, answer string")
    prompts = spark.createDataFrame([(i, k, t) for i, (k, t, _, _, _) in enumerate(CASES)], "i int, type string, truth string")
    got = {r["i"]: (r["ok"], r["pred"]) for r in E.judge_answers(answers, prompts).collect()}
    assert got == {i: (ok, pred) for i, (_, _, _, ok, pred) in enumerate(CASES)}


def test_grounding(spark):
    df = spark.createDataFrame([("see [blk_12] E7 and 2010935, E7", "prompt blk_123 with E7")], "a string, p string")
    row = df.select(*E.ground_ids(F.col("a"), F.col("p")), *E.ground_citations(F.col("a"), F.col("p"))).first()
    assert (row["n_ids"], row["hallucinated"]) == (3, "2010935")  # a prefix of a prompt id passes
    assert (row["n_citations"], row["ungrounded"]) == (1, "")


def test_halves_and_golden_set(spark):
    items = spark.createDataFrame([(i * 3,) for i in range(25)], "i int")
    halves = {r["i"]: r["half"] for r in E.half_split(items, "i").collect()}
    assert halves == {i * 3: "AB"[i % 2] for i in range(25)}
    pool = spark.range(500).withColumn("y", F.col("id") % 10 == 0)
    picked = E.golden_set(pool, "y", "id", 20)
    assert {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count("*").alias("n")).collect()} == {True: 20, False: 20}
    assert sorted(picked.collect()) == sorted(E.golden_set(pool.repartition(7), "y", "id", 20).collect())


def test_gates(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    Q.enforce(Q.gate_row_count(df, 2), Q.gate_no_orphans(df, df, "k"))
    with pytest.raises(Q.GateFailed):
        Q.enforce(Q.gate_unique(df, "k"))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all'), (2, None)], "i bigint, answer string")
    assert sorted(writers.write_csv(df, str(tmp_path / "c")).collect()) == sorted(df.collect())
    assert sorted(writers.write_json(df, str(tmp_path / "j")).collect()) == sorted(df.collect())
    assert sorted(writers.write_scores(df, str(tmp_path / "p")).collect()) == sorted(df.collect())
    writers.save_model(spark, str(tmp_path / "m"), {"threshold": 1.5})
    assert writers.load_model(spark, str(tmp_path / "m"))[0] == {"threshold": 1.5}
    readers.load_table(spark, df, "round_trip", str(tmp_path / "t"))
    assert spark.table("round_trip").count() == 2


def test_flow_log_and_eve_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"message": "1 61 eni-1 8.8.8.8 10.0.0.1 443 80 6 3 180 REJECT 2"}\n\n{"message": "short"}\n')
    assert readers.read_flow_log(spark, str(log)).count() == 1
    eve = tmp_path / "eve.json"
    flow = {"pkts_toserver": 1, "pkts_toclient": 0, "bytes_toserver": 60, "bytes_toclient": 0, "start": "2024-01-01T00:00:00.000000+0000",
            "end": "2024-01-01T00:01:00.000000+0000", "state": "new", "alerted": True}
    eve.write_text("\n".join(json.dumps(e) for e in [
        {"event_type": "flow", "flow_id": 1, "src_ip": "1.1.1.1", "flow": flow},
        {"event_type": "dns", "flow_id": 2, "dns": {"rrname": "x"}}, {"event_type": "stats"},
        {"event_type": "alert", "flow_id": 3, "alert": {"signature_id": 7, "signature": "s", "category": "c", "severity": 1}}]))
    parts = readers.read_eve(spark, str(eve))
    assert {k: v.count() for k, v in parts.items()} == {"flows": 1, "alerts": 1, "dns": 1, "anomalies": 0}
    assert parts["flows"].first()["end_ts"].isoformat() == "2024-01-01T00:01:00"
    broken = readers.eve_from_text(spark.createDataFrame([('{"event_type":"alert","flow_id":1,"alert":{}}',)], "l string"), "l")
    assert readers.missing_required(broken).first()["lacking"] == 1


def test_golden_questions_of_every_kind(spark):
    blocks = spark.range(9).select(F.concat(F.lit("blk_"), "id").alias("block_id"), (F.col("id") < 4).alias("is_anomaly"))
    hosts = spark.createDataFrame([(f"10.0.0.{i}", i < 2) for i in range(8)], "ip string, significant boolean")
    racks = spark.createDataFrame([("R01", 3), ("R02", 9)], "rack string, alerts int")
    alerted, clean = (spark.createDataFrame([(f"{n}.0.0.{i}",) for i in range(8)], "src_ip string") for n in (8, 9))
    scanners = spark.createDataFrame([("8.0.0.1", 5, 9), ("8.0.0.2", 7, 7)], "src_ip string, ports int, flows int")
    rows = E.golden_questions(blocks, hosts, racks, alerted, clean, scanners, per_stratum=3).collect()
    count, truth = {}, {}
    for r in rows:
        count[r["type"]] = count.get(r["type"], 0) + 1
        truth.setdefault(r["type"], set()).add(r["truth"])
    assert count == {"block": 6, "host": 3, "host_one": 5, "rack": 2, "template": 4, "missing": 2, "source": 12, "scanner": 2, "signature": 3}
    assert truth["host"] == {'["10.0.0.0","10.0.0.1"]'} and truth["rack"] == {"R02"} and truth["scanner"] == {"8.0.0.2"}
    for r in rows:
        expected = {"host_one": str(r["key"] in ("10.0.0.0", "10.0.0.1")).lower(), "source": str(r["key"].startswith("8.")).lower(),
                    "block": str(int(r["key"] < "blk_4")), "missing": "not found"}
        assert r["truth"] == expected.get(r["type"], r["truth"]) and r["key"] in r["question"] + r["truth"]


def test_golden_set_query_asks_every_kind(spark):
    kinds = {r["type"] for r in QUERIES["e1_golden_set"](spark, "/root/testdata/sf0.001").collect()}
    assert kinds == {"block", "host", "host_one", "rack", "template", "missing", "source", "scanner", "signature"}


def test_range_join_broadcasts_no_spread_ranges(spark):
    rules = [(i, 7 * (i % 5), 60000 + i % 3) for i in range(40)] + [(0, 0, 60000), (None, None, 5), (8, 9, 3)]
    ports = [(5, "a"), (5, "b"), (60001, "c"), (None, "d"), (256, "e")]
    r = spark.createDataFrame(rules, "rule int, lo int, hi int")
    joined = range_join(r, spark.createDataFrame(ports, "port int, name string"), "lo", "hi", "port")
    assert joined.columns == ["rule", "lo", "hi", "port", "name"]
    expected = [(*x, *p) for x in rules for p in ports if x[1] is not None and p[0] is not None and x[1] <= p[0] <= x[2]]
    assert sorted(map(tuple, joined.collect())) == sorted(expected)
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
