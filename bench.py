"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3; the median is reported), BENCH_QUERIES (comma list).
Each query is timed end to end (plan build incl. eager checkpoints + full
execution into a no-op sink) with the per-query memo cleared, after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["top_headlines", "near_dup_edges", "novelty", "greedy_dedup", "triage", "increment_stats", "text_report"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from headline_engine.plans import queries as Q
    from headline_engine.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="headline_bench")
    qs = Q.QUERIES

    def run(name: str) -> float:
        Q.reset_memo()
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(names[0])  # warm-up: JVM, codegen caches, file listing
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(name) for _ in range(repeat)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
