"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_QUERIES comma list of query names (default: the headline queries below)
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from elastiq.plans.queries import QUERIES

HEADLINE = [
    "fee_tiers",
    "sessions_in_zones",
    "last_fee",
    "sessions_with_fee",
    "group_impact",
    "vendor_metrics",
    "percentile_screen",
    "screening_funnel",
    "vendor_curve",
    "group_curve",
    "vendor_labels",
    "final_list",
    "vendor_fee_perf",
    "tier_elasticity",
    "reconcile_by_cluster",
    "full_run_labels",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("elastiq-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths on a small query
    QUERIES["vendor_metrics"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
