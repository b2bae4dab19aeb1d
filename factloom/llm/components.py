"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factloom.llm.common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.where("a > b").unionByName(
        least.select("a", F.col("least").alias("b"))
    ).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns (node, component), component being the smallest node reachable.

    `edges` has two columns of one orderable type, in any direction; repeated edges, self
    loops and edges with a null end are allowed and link nothing further.  Only nodes of an
    edge between two different nodes are returned.  Both steps work on minima, which are
    combined before the shuffle, so a hub with any number of edges never has them gathered
    in one task.  Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest path.
    """
    first, second = edges.columns
    edges = edges.select(F.col(first).alias("a"), F.col(second).alias("b"))
    current = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(current)
    while state[0]:
        following = written(_small_star(_large_star(current)), "edges")
        reached = _state(following)
        discard(current)
        current = following
        if reached == state:
            break
        state = reached
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
