"""What a session needs before a query runs, where the cluster has not said so itself."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

REPOSITORY = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: Only for sessions without spark.checkpoint.dir: a single machine, as in tests.
SCRATCH = "/tmp/factloom-scratch"


def ready(spark: SparkSession) -> SparkSession:
    """Name a scratch folder if the session has none, and let Python workers import this code."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", SCRATCH)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if REPOSITORY not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (REPOSITORY, known) if p)
    return spark
