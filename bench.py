"""Time the headline queries of every operator family and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is run
once to warm up (class loading, code generation) and then BENCH_RUNS times (default 2); the best time counts. Results
go to Spark's ``noop`` sink, so every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from karavel.plans import registry
from karavel.session import build_session

HEADLINE = (
    "s1_read_snapshot",
    "s3_read_changes",
    "p1_scope_exclude_schema",
    "p5_limit_lobs",
    "l1_full_load",
    "l2_load_ignore_conflicts",
    "l3_resume_plan",
    "c2_net_changes",
    "c3_apply_changes",
    "c3_apply_changes_stream",
    "c4_apply_changes_keyless",
    "c8_policy_exceptions",
    "c11_sync_changed_keys",
    "v1_object_diff",
    "v4_exact_counts",
    "v6_minmax_check",
    "v8_row_diff",
    "v8_row_diff_keyless",
    "v9_migration_verdict",
    "m3_apply_rate_eta",
    "m6_copy_progress",
    "a3_blocking_tree",
    "a9_alert_events",
    "k1_timeline",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    conf = {"spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false", "spark__driver__memory": "12g"}
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        best = None
        for run in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.3f}", file=sys.stderr, flush=True)
    line = {"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps({**line, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
