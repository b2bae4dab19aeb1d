"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores, BENCH_RUNS the
timed runs per query (the median is reported, after one warm-up run), BENCH_QUERIES an
optional comma-separated selection.  The flat table and the stored knowledge that the
queries share are built once before; their times are reported under ``prepare``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from workloads import registry
from workloads.prepared import prepared
from workloads.session import ready

# These rebuild whole knowledge stores; one timed run each.
BUILDS = {"knowledge_build", "dataset_registry", "arrival_stream", "semantic_roles_all_tables"}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("factloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = session(cpus)
    shared = prepared(spark, sf_dir)
    prepare = {
        "flat_table": round(timed(lambda: shared.sales_path), 3),
        "catalog": round(timed(lambda: shared.roles), 3),
        "knowledge": round(timed(lambda: shared.workspace), 3),
    }
    seconds: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, run in registry.queries().items():
        if wanted and name not in wanted:
            continue

        def once() -> None:
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()

        try:
            if name not in BUILDS:
                once()
            times = [timed(once) for _ in range(1 if name in BUILDS else runs)]
            seconds[name] = round(statistics.median(times), 3)
        except Exception as error:  # one broken query must not hide the others
            failed[name] = str(error)[:200]
        print(name, seconds.get(name, failed.get(name)), file=sys.stderr, flush=True)
    result = {
        "metric": "sum of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
        "cpus": int(cpus),
        "prepare": prepare,
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))


if __name__ == "__main__":
    main()
