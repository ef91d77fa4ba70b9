"""Registry, table access and the stand-in views.

The benchmark tables have no logs, so each input is derived from them by a short
SQL view that Spark and the checking database both accept. `@name` stands for a
table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opslattice.plans.runtime import tune

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS: dict[str, str] = {
    # one log-like record per event; k is the number inside props
    "ev": """SELECT event_id, ts, user_id, event_type, value,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        'blk_' || CASE WHEN user_id % 2 = 1 THEN '-' ELSE '' END
            || CAST(user_id * 100 + day(ts) AS STRING) AS blk,
        CAST(CAST(floor(user_id / 256) AS BIGINT) % 256 AS STRING) || '.' || CAST(user_id % 256 AS STRING) AS tail
        FROM @events""",
    "log_raw": """SELECT CAST(event_id AS STRING) AS LineId,
        substr(CAST(CAST(ts AS DATE) AS STRING), 3, 2) || substr(CAST(CAST(ts AS DATE) AS STRING), 6, 2)
            || substr(CAST(CAST(ts AS DATE) AS STRING), 9, 2) AS Date,
        CAST(CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS INT) AS STRING) AS Time,
        CASE WHEN event_type = 'error' THEN 'WARN' ELSE 'INFO' END AS Level,
        'dfs.' || event_type AS Component,
        CASE event_type
          WHEN 'view' THEN 'Receiving block ' || blk || ' src: /10.250.' || CAST(k % 5 AS STRING) || '.'
              || CAST(user_id % 50 AS STRING) || ':50010 dest: /10.25' || CAST(k % 2 AS STRING) || '.'
              || CAST(k % 7 AS STRING) || '.' || CAST(user_id % 50 AS STRING) || ':50010'
          WHEN 'click' THEN 'BLOCK* NameSystem.addStoredBlock: blockMap updated: 10.250.' || CAST(k % 5 AS STRING)
              || '.' || CAST(user_id % 50 AS STRING) || ':50010 is added to ' || blk || ' size 67108864'
          WHEN 'purchase' THEN '10.251.' || CAST(k % 3 AS STRING) || '.' || CAST(user_id % 50 AS STRING)
              || ':50010:Transmitted block ' || blk || ' to /10.25' || CAST(k % 2 AS STRING) || '.' || CAST(k % 5 AS STRING)
              || '.' || CAST(k % 50 AS STRING) || ':50010'
          WHEN 'signup' THEN 'heartbeat from datanode ' || CAST(user_id AS STRING)
          ELSE 'writeBlock ' || blk || ' received exception' END AS Content,
        CASE event_type WHEN 'view' THEN 'E5' WHEN 'click' THEN 'E26' WHEN 'purchase' THEN 'E16' WHEN 'signup' THEN 'E2'
          ELSE CASE WHEN k % 4 = 0 THEN 'E7' ELSE 'E11' END END AS EventId,
        'template of ' || event_type AS EventTemplate
        FROM @ev""",
    "label_raw": """SELECT DISTINCT blk AS BlockId,
        CASE WHEN (user_id * 100 + day(ts)) % 9 = 0 THEN 'Anomaly' ELSE 'Normal' END AS Label
        FROM @ev WHERE (user_id * 100 + day(ts)) % 13 <> 5""",
    "hardware_raw": """SELECT CAST(event_id AS STRING) AS LineId,
        CASE WHEN event_type = 'error' THEN 'KERN' || CAST(k % 4 AS STRING) ELSE '-' END AS Label,
        CAST(1704067200 + event_id * 60 AS STRING) AS Timestamp,
        CASE WHEN k % 11 = 3 THEN 'unknown-' || CAST(user_id AS STRING)
          ELSE 'R' || lpad(CAST(user_id % 20 AS STRING), 2, '0') || '-M' || CAST(k % 2 AS STRING) || '-N'
            || substr('0123456789ABCDEF', CAST(1 + k % 16 AS INT), 1) || ':J' || CAST(k AS STRING) END AS Node
        FROM @ev""",
    "flows": """SELECT event_id AS flow_id, ts AS start_ts,
        CASE k % 3 WHEN 0 THEN ts + INTERVAL '90' SECOND WHEN 1 THEN ts + INTERVAL '5' SECOND ELSE ts END AS end_ts,
        CASE user_id % 6 WHEN 0 THEN '192.168.' WHEN 1 THEN '10.0.' WHEN 2 THEN '172.17.' WHEN 3 THEN '100.64.'
          WHEN 4 THEN '203.0.' ELSE '198.51.' END || tail AS src_ip,
        CAST(1024 + event_id % 5000 AS INT) AS src_port,
        '10.9.0.' || CAST(k % 4 AS STRING) AS dest_ip,
        CAST(CASE WHEN k % 10 = 0 THEN 22 WHEN k % 10 = 1 THEN 445 WHEN k % 10 = 2 THEN 80 ELSE k * 660 END AS INT) AS dest_port,
        CASE k % 3 WHEN 0 THEN 'UDP' ELSE 'TCP' END AS proto,
        1 + event_id % 7 AS pkts_toserver, event_id % 4 AS pkts_toclient,
        CAST(floor(value * 100) AS BIGINT) AS bytes_toserver, CAST(k * 10 AS BIGINT) AS bytes_toclient,
        CASE event_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'established' ELSE 'closed' END AS state,
        CASE k % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' ELSE 'tls' END AS app_proto,
        event_type = 'error' AS alerted
        FROM @ev""",
    "alerts": """SELECT event_id AS flow_id, ts AS alert_ts,
        CASE user_id % 6 WHEN 0 THEN '192.168.' WHEN 1 THEN '10.0.' WHEN 2 THEN '172.17.' WHEN 3 THEN '100.64.'
          WHEN 4 THEN '203.0.' ELSE '198.51.' END || tail AS src_ip,
        CAST(2000000 + k AS BIGINT) AS signature_id,
        CASE k % 5 WHEN 0 THEN 'ET DROP Dshield Block Listed' WHEN 1 THEN 'ET CINS Active Threat' WHEN 2 THEN 'ET SCAN MSSQL'
          WHEN 3 THEN 'GPL dropbox traffic' ELSE 'ET INFO user agent' END || ' group ' || CAST(k AS STRING) AS signature,
        CASE k % 3 WHEN 0 THEN 'Misc Attack' WHEN 1 THEN 'Attempted Information Leak' ELSE 'Not Suspicious' END AS category,
        CAST(1 + k % 3 AS INT) AS severity
        FROM @ev WHERE (event_type = 'error' AND k % 7 <> 6) OR (event_type = 'signup' AND k % 20 = 3)""",
    "eve_lines": """SELECT event_id, '{"event_type":"' || CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'flow'
          WHEN 'click' THEN 'dns' WHEN 'signup' THEN 'anomaly' ELSE 'stats' END
        || '","flow_id":' || CAST(event_id AS STRING) || ',"src_ip":"203.0.' || tail || '","dest_ip":"10.9.0.1","dest_port":'
        || CAST(k AS STRING) || ',"proto":"TCP","timestamp":"2024-01-0' || CAST(1 + k % 9 AS STRING) || 'T10:00:00.000000+0000"'
        || CASE event_type
          WHEN 'view' THEN ',"flow":{"pkts_toserver":' || CAST(k AS STRING) || ',"pkts_toclient":1,"bytes_toserver":'
            || CAST(k * 60 AS STRING) || ',"bytes_toclient":40,"start":"2024-01-01T00:00:00.000000+0000",'
            || '"end":"2024-01-01T00:01:00.000000+0000","state":"new","alerted":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}'
          WHEN 'error' THEN ',"alert":{"signature_id":' || CAST(2000000 + k AS STRING) || ',"signature":"ET SCAN ' || CAST(k AS STRING)
            || '","category":"Misc","severity":' || CAST(1 + k % 3 AS STRING) || '}'
          WHEN 'click' THEN ',"dns":{' || CASE WHEN k % 2 = 0 THEN '"type":"query"' ELSE '"rrname":"host' || CAST(k AS STRING) || '"' END || '}'
          WHEN 'signup' THEN ',"anomaly":{' || CASE WHEN k % 2 = 0 THEN '"event":"stream"' ELSE '' END || '}'
          ELSE '' END || '}' AS line
        FROM @ev""",
    "flow_log": """SELECT event_id, CASE WHEN event_id % 50 = 7 THEN 'short line ' || CAST(event_id AS STRING)
        ELSE CAST(1704067200 + event_id * 60 AS STRING) || ' ' || CAST(1704067260 + event_id * 60 AS STRING) || ' eni-'
          || CAST(user_id % 8 AS STRING) || ' '
          || CASE WHEN event_id % 41 = 3 THEN '-' ELSE CASE user_id % 8 WHEN 0 THEN '203.0.' || tail WHEN 1 THEN '10.1.' || tail
               WHEN 2 THEN '172.31.' || tail WHEN 3 THEN '100.64.' || tail WHEN 4 THEN '2001:db8::' || CAST(user_id AS STRING)
               WHEN 5 THEN 'unknown' WHEN 6 THEN '198.51.' || tail ELSE '192.168.' || tail END END || ' '
          || CASE k % 6 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN 'garbage' ELSE '10.9.0.' || CAST(k % 4 AS STRING) END
          || ' 443 ' || CASE WHEN k % 17 = 5 THEN '-' WHEN k % 10 = 0 THEN '22' WHEN k % 10 = 1 THEN '80' ELSE CAST(k * 660 AS STRING) END
          || ' ' || CASE k % 4 WHEN 0 THEN '6' WHEN 1 THEN '17' WHEN 2 THEN '1' ELSE '47' END || ' 3 180 '
          || CASE WHEN event_type = 'error' THEN 'ACCEPT' WHEN event_type = 'signup' THEN 'NODATA' ELSE 'REJECT' END || ' 2' END AS message
        FROM @ev""",
    # topology: orders are blocks, suppliers are the hosts that hold them
    "block_lines": """SELECT 'blk_' || CAST(l_orderkey AS STRING) AS block_id, l_orderkey AS block_no,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_discount >= 0.09 THEN 'E7'
          ELSE CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'E5' WHEN 'AO' THEN 'E22' WHEN 'NF' THEN 'E26'
            WHEN 'NO' THEN 'E11' WHEN 'RF' THEN 'E9' ELSE 'E21' END END AS event_id,
        '10.25' || CAST(l_suppkey % 2 AS STRING) || '.' || CAST(CAST(floor(l_suppkey / 256) AS BIGINT) % 256 AS STRING) || '.'
            || CAST(l_suppkey % 256 AS STRING) AS host_ip
        FROM @lineitem""",
    "blocks": """SELECT 'blk_' || CAST(o_orderkey AS STRING) AS block_id, o_orderkey AS block_no, o_orderdate AS first_ts,
        o_orderstatus = 'F' AS is_anomaly, o_totalprice / 100000 AS residual, o_totalprice > 450000 AS flag FROM @orders""",
    "placement": "SELECT DISTINCT l_orderkey AS block_no, l_suppkey AS host FROM @lineitem",
    "order_labels": "SELECT o_orderkey AS block_no, o_orderstatus = 'F' AS is_anomaly FROM @orders",
    # answers and prompts: two runs over the assistant turns
    "prompts": """SELECT conv_id * 100 + turn AS i,
        CASE conv_id % 9 WHEN 0 THEN 'block' WHEN 1 THEN 'host' WHEN 2 THEN 'host_one' WHEN 3 THEN 'source' WHEN 4 THEN 'rack'
          WHEN 5 THEN 'scanner' WHEN 6 THEN 'template' WHEN 7 THEN 'signature' ELSE 'missing' END AS type,
        CASE conv_id % 9 WHEN 0 THEN CAST(turn % 4 % 2 AS STRING) WHEN 1 THEN '["10.0.0.1","10.0.0.2"]'
          WHEN 2 THEN CASE WHEN turn % 4 = 1 THEN 'true' ELSE 'false' END WHEN 3 THEN CASE WHEN turn % 4 = 1 THEN 'true' ELSE 'false' END
          WHEN 4 THEN 'R30' WHEN 5 THEN '203.0.113.9' WHEN 6 THEN 'E7' WHEN 7 THEN '2010935' ELSE 'not found' END AS truth,
        'Question about blk_' || CAST(conv_id AS STRING) || ' on 10.0.0.1 and R30: ' || text AS prompt
        FROM @conversations WHERE role = 'assistant'""",
    "answers": """SELECT i, run, lead || body || tail AS answer, latency_ms FROM (
        SELECT c.conv_id * 100 + c.turn AS i, c.run,
          CASE (c.conv_id * 3 + c.turn + c.shift) % 12
            WHEN 0 THEN 'Verdict: yes, the source is malicious [blk_7]' WHEN 1 THEN 'No anomaly was detected in blk_123'
            WHEN 2 THEN '**Verdict:** No need to worry about 203.0.113.9' WHEN 3 THEN 'The block looks anomalous, see E7 and R30'
            WHEN 4 THEN 'Block is healthy and normal' WHEN 5 THEN 'Host 10.0.0.1 (significant) and [10.0.0.2] are elevated (significant)'
            WHEN 6 THEN 'Sorry, blocked by our content filters' WHEN 7 THEN 'Signature 2010935: risk is low, not elevated'
            WHEN 8 THEN 'The id was not found' WHEN 9 THEN 'FLAGGED: high risk, anomal behaviour' WHEN 10 THEN 'It does not appear, not healthy'
            ELSE 'Traffic from 203.0.113.9 was flagged; [R30] has no alerts' END AS lead,
          ' ' || c.text AS body, ' (blk_' || CAST(c.conv_id AS STRING) || ')' AS tail,
          CAST((c.conv_id * 37 + c.turn * 11 + c.shift * 5) % 4000 AS DOUBLE) AS latency_ms
        FROM (SELECT conv_id, turn, role, text, 'v1' AS run, 0 AS shift FROM @conversations
            UNION ALL SELECT conv_id, turn, role, text, 'v2', 5 FROM @conversations) c WHERE c.role = 'assistant') x""",
    "questions": """SELECT conv_id * 100 + turn AS qid, text || CASE (conv_id + turn) % 6
          WHEN 0 THEN ' Why did block blk_' || CAST(conv_id * 7 AS STRING) || ' fail? Compare blk_' || CAST(conv_id * 7 + 1 AS STRING)
          WHEN 1 THEN ' How risky is host 10.25' || CAST(conv_id % 2 AS STRING) || '.0.' || CAST(conv_id % 2 + 2 * (conv_id % 50) AS STRING) || '?'
          WHEN 2 THEN ' Which rack R' || lpad(CAST(conv_id % 20 AS STRING), 2, '0') || ' has the most BGL alerts?'
          WHEN 3 THEN ' Which source IPs are scanning us?' WHEN 4 THEN ' Are BGL alerts concentrated, and on which hosts?'
          ELSE ' Is 203.0.0.' || CAST(4 + 6 * (conv_id % 20) AS STRING) || ' malicious? blk_-' || CAST(conv_id AS STRING) || ' blk_-' || CAST(conv_id AS STRING) END AS question
        FROM @conversations WHERE role = 'user'""",
    # configuration: parts are security groups, orders are interfaces, customers are load balancers
    "sg_groups": """SELECT p_partkey AS sg_id, CASE WHEN p_size = 1 THEN 'default' ELSE p_brand END AS name,
        'NATION_' || CAST(p_partkey % 25 AS STRING) AS region FROM @part""",
    "sg_rules": """SELECT p_partkey AS sg_id, CASE p_type WHEN 'PROMO' THEN '-1' WHEN 'SMALL' THEN 'udp' ELSE 'tcp' END AS proto,
        CAST(CASE WHEN p_type = 'LARGE' AND p_size > 45 THEN NULL WHEN p_size = 2 THEN -1 ELSE p_size * 660 END AS INT) AS port_from,
        CAST(p_size * 660 + 3300 AS INT) AS port_to,
        CASE p_partkey % 4 WHEN 0 THEN '0.0.0.0/0' WHEN 1 THEN '::/0' WHEN 2 THEN '10.0.0.0/8' ELSE '' END AS cidr FROM @part""",
    "interfaces": """SELECT o_orderkey AS eni, 'NATION_' || CAST(o_custkey % 25 AS STRING) AS region, o_orderpriority AS type,
        o_orderstatus = 'F' AS public_ip, l_partkey AS sg_id
        FROM @orders LEFT JOIN (SELECT * FROM @lineitem WHERE l_partkey % 5 <> 2) li ON o_orderkey = l_orderkey""",
    "listeners": """SELECT 'NATION_' || CAST(c_nationkey AS STRING) AS region, c_name AS load_balancer,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'internet-facing' ELSE 'internal' END AS scheme,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'HTTPS' WHEN o_orderpriority = '2-HIGH' THEN 'TCP' ELSE 'HTTP' END AS protocol
        FROM @customer JOIN @orders ON c_custkey = o_custkey""",
}


def expand(text: str, base: str = "") -> str:
    """Replace @names: views by their SQL, tables by base + name."""
    def put(match: re.Match) -> str:
        name = match.group(1)
        return f"({expand(VIEWS[name], base)})" if name in VIEWS else f"{base}{name}"

    return re.sub(r"@([a-z_]+)", put, text)


class Tables:
    """Named access to base tables and stand-in views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(f"SELECT * FROM @{name} v")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The frame of that name, made at its first use in a query."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        full = expand(text, "opslattice_")
        for name in set(re.findall(r"\bopslattice_([a-z]+)\b", full)):
            self(name).createOrReplaceTempView(f"opslattice_{name}")
        return self.spark.sql(full)


def query(name: str, sql: str | None = None):
    """Register a function Tables -> DataFrame under `name`, with its SQL counterpart if there is one."""
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return register
