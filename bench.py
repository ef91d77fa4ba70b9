"""Time the headline queries once each and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
A small query on the same session warms the JVM up before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opslattice.catalog import QUERIES  # noqa: E402
from opslattice.plans.runtime import local_session  # noqa: E402

HEADLINE = [
    "a1_session_rollup", "a6_flow_edges", "a8_fan_out", "a24_source_summary", "d1_rule_detector", "d2_pca_residual",
    "d6_binary_metrics", "d8_neighbour_risk_detector", "d10_next_event_scores", "d12_binomial_hotspots",
    "h1_cooccurrence_graph", "h3_k_hop", "h4_shortest_paths", "t1_hourly_counts", "t2_robust_z_burst",
    "t3_correlate_incidents", "n5_audit_report", "n6_audit_flow_log", "x1_build_knowledge_base", "x4_bm25_topk",
    "x8_session_report", "e3_judge_answer", "e5_eval_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "opslattice-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["a6_flow_edges"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
