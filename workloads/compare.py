"""Run registered queries next to their SQL counterparts and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from workloads import oracle, registry
from workloads.session import ready


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in registry.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    con = con or connect(sf_dir)
    started = time.time()
    result = registry.queries()[name](spark, sf_dir)
    ours = rows_of(result.columns, result.collect())
    spark_time, started = time.time() - started, time.time()
    cursor = con.execute(oracle.statements()[name])
    columns = [d[0] for d in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    times = f"spark {spark_time:.1f}s sql {time.time() - started:.1f}s rows {sum(ours.values())}"
    if sorted(columns) != sorted(result.columns):
        return False, f"columns {sorted(result.columns)} / {sorted(columns)}"
    if ours != theirs:
        only_ours = list((ours - theirs).items())[:4]
        only_theirs = list((theirs - ours).items())[:4]
        return False, f"{times} {sum((ours - theirs).values())} differ\n  spark {only_ours}\n  sql   {only_theirs}"
    return True, times


def main() -> None:
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(registry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ready(spark)
    con = connect(sf_dir)
    for name in names:
        try:
            good, note = compare(spark, sf_dir, name, con)
        except Exception as error:
            good, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok   " if good else "FAIL ") + name, note, flush=True)


if __name__ == "__main__":
    main()
