"""Scans, and the folder that scratch tables are written to."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from factloom.sources.csv import scan_csv


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read one flat dataset in stored row order; CSV goes through type inference."""
    if fmt == "csv":
        return scan_csv(spark, path, **options)
    return spark.read.format(fmt).options(**options).load(path)


def is_scan(df: DataFrame) -> bool:
    """True if the rows are read from one stored table, so that columns can be read by themselves."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def scan_bytes(df: DataFrame) -> int:
    """The size of what is read, as the planner estimates it: for a scan that of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def scratch_dir(spark: SparkSession, purpose: str, base: str | None = None) -> str:
    """A fresh folder below a shared one: ``base``, or what the session calls spark.checkpoint.dir."""
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("no shared scratch folder: set spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, purpose: str, base: str | None = None) -> DataFrame:
    """Write the rows once to the shared scratch folder and go on from the written table.

    For results that several later steps use and that are costly to compute again.
    """
    path = scratch_dir(df.sparkSession, purpose, base)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
