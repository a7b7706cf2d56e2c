"""Time the library's queries and print one JSON line.

    BENCH_SF_DIR   folder of the tables            (default /root/testdata/sf0.1)
    BENCH_CPUS     cores of the local session      (default 8)
    BENCH_QUERIES  comma-separated names            (default: every query of the library's own operators)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("caseflow-bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from caseflow.plans.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    chosen = os.environ.get("BENCH_QUERIES", "all")
    names = list(QUERIES) if chosen == "all" else chosen.split(",")
    spark = session()
    for _ in range(2):  # let the JVM compile the text paths
        QUERIES["ingest_cases"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)$", sf_dir)
    print(json.dumps({"metric": "total time of all queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else sf_dir}))


if __name__ == "__main__":
    main()
