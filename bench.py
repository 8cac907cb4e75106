"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and three times for the median. Results go to a sink that
keeps nothing, so every row and column is computed but none is sent to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from querytide.plans.catalog import QUERIES
from querytide.session import local_session

HEADLINE = (
    "log_parse",
    "summary",
    "top_domains",
    "blocked_domains",
    "per_client",
    "client_top_domains",
    "off_hours_domains",
    "novel_domains",
    "new_domains",
    "daily_volume",
    "volume_baseline",
    "volume_anomalies",
    "counter_delta",
    "packet_sections",
    "bulk_summary",
    "bulk_top_domains",
    "bulk_client_top_domains",
    "bulk_off_hours_domains",
    "bulk_new_domains",
    "bulk_volume_baseline",
    "bulk_volume_anomalies",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
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
