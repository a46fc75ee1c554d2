"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every query runs once to
warm up and is then timed end to end: building the plan, planning it, and computing every row.
"""

from __future__ import annotations

import json
import os
import time

from propstats.catalog.queries import queries
from propstats.session import local_session

HEADLINE = [
    "area_price_trends",
    "district_price_trends",
    "sector_price_trends",
    "multi_level_stats",
    "ingest_csv_roundtrip",
    "qa_null_counts",
    "qa_price_summary",
    "qa_ranges",
    "district_numbering",
    "hotspot_ranking",
    "type_counts_all_years",
    "spatial_within_inner",
    "spatial_within_shapes",
    "spatial_within_detailed",
    "geometry_validity",
    "district_socio",
    "district_trends_with_socio",
    "mart_rejoined",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
