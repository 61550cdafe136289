"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and cores.
Every query runs once cold and twice warm; the reported time is the best warm run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from fieldcheck.queries import QUERIES
from fieldcheck.session import tuned

HEADLINE = [
    "flagship_month_labels", "c2_parse_strip", "g1_latest_file_per_site_day",
    "e1_semi_latest_files", "f7_quantiles", "l1_guardrail_lineitem", "l2_outlier_log",
    "l5_profile_clinical", "l5_profile_lineitem", "l5_profile_raw", "l9_heaping_window",
    "l10_heaping_daily", "l13_heaping_pivot_ratio", "l15_histogram", "l18_histogram_compare",
    "l21_anonymize", "l22_digit_runs_documents", "l23_incremental_refresh",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fieldcheck-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        # Call sites of every column expression are for debugging only.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    run(spark, "f1_count_by", sf_dir)
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
    print(json.dumps({
        "metric": "total warm time of the headline queries", "value": round(sum(warm.values()), 3),
        "unit": "sec", "queries": warm, "cold": cold,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
