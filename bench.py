"""
Times the headline queries: one warm-up, then the median of three runs each. Prints one
JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from gridmere.catalog import QUERIES
from gridmere.session import local_session

HEADLINE = [
    "asof_backward", "asof_nearest", "index_year_on_year", "nearest_point", "nearest_k_points",
    "point_in_polygon", "area_point_counts", "smallest_lot", "merged_stops", "best_routes",
    "correspondence", "weighted_crosswalk", "release_rescale", "monthly_trend", "yearly_trend",
    "incident_rates", "dense_panel", "keep_latest_copies", "last_values", "share_of_total",
    "label_flags", "pearson_matrix", "wide_pearson_matrix", "master_table", "clean_listings", "listing_csv_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for i in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t)
        seconds[name] = round(statistics.median(runs), 4)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found[1]) if found else None,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
