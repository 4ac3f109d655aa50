"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query starts from the raw tables; nothing is shared between queries.
"""

from __future__ import annotations

import json
import os
import time

from paneltide.plans import catalog
from paneltide.session import build_session

HEADLINE = (
    "build_bars",
    "feature_panel",
    "build_graph",
    "best_first_neighbourhood",
    "edge_walk_k",
    "run_metrics",
    "paired_bootstrap",
    "mi_permutation",
    "trajectory_gae",
    "flagship",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="paneltide-bench")
    catalog.QUERIES["masked_entropy"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
