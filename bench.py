"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times; the median counts. A run builds the query and
consumes every result row.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pertmatrix.plans import QUERIES  # noqa: E402
from pertmatrix.session import local_session  # noqa: E402

HEADLINE = (
    "cell_libsize", "normalize_log1p", "pb_stream_sums", "pb_mean_var_cpm", "pb_median", "pb_bootstrap", "sample_cap_per_label",
    "context_profile", "log2fc_with_var", "transfer_delta", "backbone_delta", "apply_delta_cells", "allocate_even", "de_wilcoxon",
    "metric_nsig", "metric_pds_cosine", "validate_block_values", "join_edges_both_endpoints", "manifest_gate", "e_distance", "stream_pb_sums",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(once(name), 3)
        warm[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    total = round(sum(warm.values()), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": warm, "first_run": cold, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
