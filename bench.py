"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set input and cores. Every
query builds all its tables anew: nothing is shared between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from stackweave.plans import trace
from stackweave.plans.queries import QUERIES
from stackweave.session import build_session

HEADLINE = [
    "quality_report", "build_source_locations", "location_ids_for_samples", "classify_branches",
    "assign_loss_epoch", "reconstruct_stacks", "normalize_depths", "reconstruction_summary",
    "trace_event_export", "check_well_nested", "resolve_symbol_asof", "thread_comm_chain",
    "sample_frame_containment", "nested_overlap", "rate_from_counter", "frame_islands",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["source_stats"](spark, folder).collect()  # start the JVM's code paths
    times = {}
    for name in chosen:
        trace.forget()
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "trace_queries_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
