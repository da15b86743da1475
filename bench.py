"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed completely through the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "t10_standard_features",
    "p20_clean_log",
    "o1_open_cases",
    "o2b_open_cases_sequential_ties",
    "l6_build_targets",
    "d1_temporal_split",
    "d5_prefix_log",
    "e10_encode_combined",
    "e10c_encode_indexbased",
    "f5_predict_flow",
    "f6_predict_direct_mean",
    "v12_stability",
    "r2_stream_state",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from procmon.plans import registry
    from procmon.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", os.environ.get("BENCH_CPUS", "8"))), app="procmon-bench")
    registry.load_all()
    keys = [k for k in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if k]
    # warm-up: JVM, parquet footers and Python workers
    registry.QUERIES["t1_time_since_last"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        t = time.time()
        registry.QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
