"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.session import local_session
from tidemark.workload import QUERIES

HEADLINE = [
    "catch_by_area_wide",
    "catch_inseason_extrapolate",
    "comp_length_fishery",
    "comp_caal",
    "comp_age_marginal",
    "scen_fan",
    "agg_median_quantiles",
    "join_group_total",
    "agg_count_distinct",
    "bycatch_nontarget_share",
    "index_area_wide",
    "smooth_random_walk",
    "spatial_idw_grid",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "12g")
    out = {}
    for name in HEADLINE:
        run = lambda q=QUERIES[name]: q(spark, folder)
        timed(run)
        out[name] = round(statistics.median(timed(run) for _ in range(3)), 3)
    line = {
        "metric": "headline queries, sum of median seconds of 3 runs after a warm-up",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
