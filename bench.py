"""Headline queries on the given tables; prints one JSON line.

Each query is planned and run in full (all rows and columns are produced, none
are collected); the better of two runs is reported, in seconds.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from hearthline.plans import catalog

HEADLINE = [
    "master_events",
    "household_timeline",
    "household_trajectory",
    "score_deltas",
    "pivot_scores",
    "dedup_keep_first",
    "repair_text",
    "load_scores",
    "elig_by_programme",
    "score_stats",
    "score_hist",
    "volatility_programme",
    "volatility_region",
    "delta_box",
    "adj_delta_monthly",
    "weekly_abs_delta",
    "churn_region",
    "monthly_flows",
    "beneficiary_flows",
    "churn_timeline",
    "reentry_summary",
    "score_timeseries",
    "score_timeseries_dims",
    "near_threshold_ts",
    "score_ts_region",
    "qc_summary",
    "household_history",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hearthline-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    catalog.build(name, spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, "elig_by_programme", folder)
    seconds = {
        name: round(min(timed(spark, name, folder) for _ in range(2)), 3) for name in HEADLINE
    }
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
