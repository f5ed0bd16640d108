"""Headline queries on the bench tables; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

from parcelwise.plans import QUERIES
from parcelwise.session import local_session

HEADLINE = (
    "h2_summary_by_action", "b14_defect_score", "c2_orders_before", "c10_resolved_rates", "d9_ring_statistics", "d16_published_ring_features",
    "f8_conformal_sweep", "h3_policy_comparison", "h5_friction_frontier", "i4_shrunk_estimates", "j2_rolling_hour", "j1_drift_windows_streamed", "k6_criteria",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus), "parcelwise-bench")
    # the first job pays for the JVM and the code generator
    QUERIES["g7_expected_costs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
