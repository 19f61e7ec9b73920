"""Time the headline queries: prints one JSON line with seconds per query and their sum.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores).
Every query is run in full into a sink that discards rows; the best of BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from answerlake import session
from answerlake.plans import catalog

HEADLINE = (
    "ag_score",
    "wn_running_score",
    "dc_local_threshold",
    "dc_field_summary",
    "dc_measure",
    "rl_chain",
    "ag_facets",
    "jn_dup_job",
    "wn_neighbours",
    "ag_assignment_summary",
    "ag_changed_sheets",
    "jn_external",
    "cp_fields",
    "cp_reconciled",
    "ag_metrics_values",
    "ag_metrics_by_kind",
    "ag_latency",
    "ag_label_corr",
    "prj_column_plan",
    "rv_apply",
    "ml_samples",
    "src_delimited",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = session.build(
        "answerlake-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            seconds[name] = min(seconds.get(name, took), took)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in seconds.items()},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
