"""Every measure by every single dimension, from one pass over the data.

The dimensions are unpivoted to (dimension, value) rows that carry the measures, so one
grouped aggregation serves all of them.  Partial sums are formed on the map side: a value
that fills a third of the table reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from factloom.functions.columns import (
    NULL_TEXT,
    dimension_text,
    fact_hash,
    measure,
)

CUBE_SCHEMA = (
    "dimension_ordinal int, dimension string, value string, metric_ordinal int,"
    " metric string, sum double, mean double, count bigint, variance double"
)
FACT_SCHEMA = (
    "dimension_ordinal int, dimension string, dimension_value string, is_null boolean,"
    " metric_ordinal int, metric string, sum double, mean double, count bigint"
)


def valid_measures(df: DataFrame, measures: Sequence[str]) -> list[str]:
    """Measures that hold at least one usable number."""
    if not measures:
        return []
    counts = df.agg(*[F.count(measure(df, m)) for m in measures]).first()
    return [m for m, n in zip(measures, counts) if n]


def _grouped(df: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    carried = [f"m{i}" for i in range(len(measures))]
    unpivoted = df.select(
        *[dimension_text(df, d).alias(str(i)) for i, d in enumerate(dimensions)],
        *[measure(df, m).alias(c) for m, c in zip(measures, carried)],
    ).unpivot(carried, [str(i) for i in range(len(dimensions))], "slot", "value")
    aggregates = []
    for i in range(len(measures)):
        m = F.col(f"m{i}")
        aggregates += [
            F.sum(m).alias(f"sum{i}"),
            F.count(m).alias(f"count{i}"),
            F.var_samp(m).alias(f"var{i}"),
        ]
    slot = F.col("slot").cast("int")
    return (
        unpivoted.groupBy("slot", "value")
        .agg(*aggregates)
        .withColumn("dimension_ordinal", F.get(F.lit([df.columns.index(d) for d in dimensions]), slot))
        .withColumn("dimension", F.get(F.lit(list(dimensions)), slot))
    )


def _metric_entries(df: DataFrame, measures: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(df.columns.index(m)).alias("metric_ordinal"),
                F.lit(m).alias("metric"),
                F.col(f"sum{i}").alias("sum"),
                F.try_divide(f"sum{i}", f"count{i}").alias("mean"),
                F.col(f"count{i}").alias("count"),
                F.col(f"var{i}").alias("variance"),
            )
            for i, m in enumerate(measures)
        ]
    )


def cube(df: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Long form: one row per dimension, value (NULL is a value) and metric."""
    if not dimensions or not measures:
        return df.sparkSession.createDataFrame([], CUBE_SCHEMA)
    return _grouped(df, dimensions, measures).select(
        "dimension_ordinal", "dimension", "value", F.inline(_metric_entries(df, measures))
    )


def merged_cubes(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """The cube of two sets of rows from the cubes of each.

    Means and squares are joined around the common mean, which keeps the digits that sums of
    squares would lose.
    """
    key = ["dimension_ordinal", "dimension", "value", "metric_ordinal", "metric"]
    squares = F.coalesce(F.col("variance"), F.lit(0.0)) * F.greatest(F.col("count") - 1, F.lit(0))
    sides = [
        part.select(*key, "sum", "mean", "count", squares.alias("squares"), F.lit(side).alias("side"))
        for side, part in enumerate((earlier, later))
    ]

    def of_side(side: int, column: str) -> Column:
        # A group has one row at most in each cube.
        return F.max(F.when(F.col("side") == side, F.col(column)))

    # Numbers only, so that no group needs an object of its own while it is put together.
    merged = sides[0].unionByName(sides[1]).groupBy(*key).agg(
        F.sum("sum").alias("sum"),
        F.sum("count").alias("count"),
        *[
            F.coalesce(of_side(i, c), F.lit(0)).alias(f"{c}{i}")
            for i in (0, 1)
            for c in ("mean", "count", "squares")
        ],
    )
    n, a, b = F.col("count"), F.col("count0"), F.col("count1")
    apart = F.col("mean1") - F.col("mean0")
    both = F.col("squares0") + F.col("squares1") + F.try_divide(apart * apart * a * b, n)
    joined = F.when(a == 0, F.col("squares1")).when(b == 0, F.col("squares0")).otherwise(both)
    return merged.select(
        *key,
        "sum",
        F.try_divide("sum", n).alias("mean"),
        n,
        F.when(n > 1, F.try_divide(joined, n - 1)).alias("variance"),
    )


def facts_from_cube(cubed: DataFrame, measures: Sequence[str], merge_null_text: bool = True) -> DataFrame:
    """Stored facts: the NULL group becomes ``(null)``, its empty sums become 0.

    A column may also hold the text ``(null)``; both groups are then one fact.  The
    catalog knows whether such text exists, and the merge is left out if it does not.
    """
    facts = cubed.where(F.col("metric").isin(list(measures))).select(
        "dimension_ordinal",
        "dimension",
        F.coalesce("value", F.lit(NULL_TEXT)).alias("dimension_value"),
        F.col("value").isNull().alias("is_null"),
        "metric_ordinal",
        "metric",
        F.coalesce("sum", F.lit(0.0)).alias("sum"),
        "mean",
        "count",
    )
    if not merge_null_text:
        return facts
    return (
        facts.groupBy("dimension_ordinal", "dimension", "dimension_value", "metric_ordinal", "metric")
        .agg(
            F.bool_or("is_null").alias("is_null"),
            F.sum("sum").alias("sum"),
            F.sum("count").alias("count"),
        )
        .withColumn("mean", F.try_divide("sum", "count"))
        .select(*facts.columns)
    )


def facts(
    df: DataFrame,
    dimensions: Sequence[str],
    measures: Sequence[str],
    merge_null_text: bool = True,
) -> DataFrame:
    """Sum, mean and count of every usable measure by every dimension value."""
    usable = valid_measures(df, measures) if dimensions else []
    if not usable:
        return df.sparkSession.createDataFrame([], FACT_SCHEMA)
    return facts_from_cube(cube(df, dimensions, usable), usable, merge_null_text)


def nonnull_facts(df: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Variant that leaves out rows where the dimension or the measure is missing."""
    return (
        cube(df, dimensions, measures)
        .where(F.col("value").isNotNull() & (F.col("count") > 0))
        .select("dimension", F.col("value").alias("dimension_value"), "metric", "sum", "mean", "count")
    )


def with_fact_hash(stored: DataFrame) -> DataFrame:
    return stored.withColumn("fact_id", fact_hash(F.col("dimension"), F.col("dimension_value")))


def facts_as_maps(stored: DataFrame) -> DataFrame:
    """One row per dimension value with all its metrics as a map.

    The map is bounded by the number of measures of the dataset.
    """
    def entry(suffix: str, value: str) -> Column:
        return F.struct(
            F.concat("metric", F.lit(suffix)).alias("key"), F.col(value).cast("double").alias("value")
        )

    return (
        stored.groupBy("dimension_ordinal", "dimension", "dimension_value", "is_null")
        .agg(
            F.map_from_entries(
                F.flatten(
                    F.collect_list(
                        F.array(entry("_sum", "sum"), entry("_mean", "mean"), entry("_count", "count"))
                    )
                )
            ).alias("metrics")
        )
        .withColumn("dimensions", F.create_map("dimension", "dimension_value"))
        .withColumn("fact_id", fact_hash(F.col("dimension"), F.col("dimension_value")))
    )


def list_facts(stored: DataFrame, dimension: str | None = None, limit: int = 100) -> DataFrame:
    """Facts in store order (column order, then value, missing last), at most ``limit``.

    Every fact has a row for each metric of the dataset, so the first rows hold the first
    facts and nothing else has to be put together.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    chosen = stored if dimension is None else stored.where(F.col("dimension") == dimension)
    metrics = chosen.select("metric").distinct().count()
    order = ["dimension_ordinal", "is_null", "dimension_value"]
    first_rows = chosen.orderBy(*order, "metric_ordinal").limit(limit * max(metrics, 1))
    return (
        facts_as_maps(first_rows)
        .orderBy(*order)
        .limit(limit)
        .select("fact_id", "dimensions", "metrics")
    )
