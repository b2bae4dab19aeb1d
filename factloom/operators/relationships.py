"""Pairwise evidence: how dimensions and measures relate.

Dimension/measure evidence is computed from the cube, so the data are read once for all
pairs.  Measure/measure evidence needs one more pass for all pairs together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.functions.columns import is_finite, measure
from factloom.functions.distributions import f_survival

CORRELATION_FLOOR = 0.3
STRENGTH_EPSILON = 1e-9

RELATIONSHIP_SCHEMA = (
    "column_a string, column_b string, rel_type string, strength_score double,"
    " significance_score double, top_contributor string, correlation double"
)
PAIR_KEY = ["dimension_ordinal", "dimension", "metric_ordinal", "metric"]


def group_stats(cubed: DataFrame) -> DataFrame:
    """Mean, count and deviation per group; rows with either side missing are left out."""
    return cubed.where(F.col("value").isNotNull() & (F.col("count") > 0)).select(
        *PAIR_KEY, "value", "sum", "mean", "count", "variance", F.sqrt("variance").alias("std")
    )


def variation(groups: DataFrame) -> DataFrame:
    """Per pair: strength, and the inputs of the variance analysis.

    Strength is the unweighted sample deviation of the group means relative to the overall
    mean, capped at 1; where it is undefined or infinite it is 0.
    """
    kept = F.col("count") > 1
    global_mean = F.col("all_sum") / F.col("all_count")
    ratio = F.abs(F.col("mean_deviation") / (F.abs(global_mean) + STRENGTH_EPSILON))
    return (
        groups.groupBy(*PAIR_KEY)
        .agg(
            F.stddev_samp("mean").alias("mean_deviation"),
            F.sum("sum").alias("all_sum"),
            F.sum("count").alias("all_count"),
            F.count(F.lit(1)).alias("group_count"),
            F.count_if(kept).alias("kept_groups"),
            F.sum(F.when(kept, F.col("count"))).alias("kept_rows"),
            F.sum(F.when(kept, F.col("sum"))).alias("kept_sum"),
            F.sum(F.when(kept, (F.col("count") - 1) * F.col("variance"))).alias("ss_within"),
        )
        .withColumn("global_mean", global_mean)
        .withColumn(
            "strength_score",
            F.when(is_finite(ratio), F.least(ratio, F.lit(1.0))).otherwise(0.0),
        )
        .withColumn("kept_mean", F.try_divide("kept_sum", "kept_rows"))
    )


def anova(groups: DataFrame, varied: DataFrame | None = None) -> DataFrame:
    """One-way analysis of variance per pair over groups of at least two rows.

    The squares between groups are taken around the final mean in a second step over the
    groups; the one-step formula loses all digits when means are large.  The side that is
    broadcast has one row per pair of columns.
    """
    varied = variation(groups) if varied is None else varied
    key = ["dimension", "metric"]
    between = (
        groups.where(F.col("count") > 1)
        .join(F.broadcast(varied.select(*key, "kept_mean")), key)
        .groupBy(*key)
        .agg(F.sum(F.col("count") * F.pow(F.col("mean") - F.col("kept_mean"), 2)).alias("ss_between"))
    )
    df_between = F.col("kept_groups") - 1
    df_within = F.col("kept_rows") - F.col("kept_groups")
    ms_between = F.try_divide("ss_between", df_between)
    ms_within = F.try_divide("ss_within", df_within)
    statistic = F.when(
        F.col("kept_groups") >= 2,
        F.when(
            (F.col("ss_within") == 0) & (F.col("ss_between") > 0), F.lit(float("inf"))
        ).otherwise(F.try_divide(ms_between, ms_within)),
    )
    return (
        varied.join(between, key, "left")
        .withColumn("df_between", df_between)
        .withColumn("df_within", df_within)
        .withColumn("f_statistic", statistic)
    )


def top_contributor(groups: DataFrame) -> DataFrame:
    """Group with the highest mean per pair; equal means go to the first key."""
    by_mean = Window.partitionBy(*PAIR_KEY).orderBy(F.desc("mean"), F.asc("value"))
    return (
        groups.withColumn("place", F.row_number().over(by_mean))
        .where(F.col("place") == 1)
        .select(*PAIR_KEY, F.col("value").alias("top_contributor"), F.col("mean").alias("top_mean"))
    )


def category_evidence(cubed: DataFrame) -> DataFrame:
    """Evidence rows for all pairs of a dimension and a measure."""
    groups = group_stats(cubed)
    tested = anova(groups)
    best = top_contributor(groups).select("dimension", "metric", "top_contributor")
    return tested.join(best, ["dimension", "metric"]).select(
        F.col("dimension").alias("column_a"),
        F.col("metric").alias("column_b"),
        F.lit("cat_num").alias("rel_type"),
        "strength_score",
        f_survival(F.col("f_statistic"), F.col("df_between"), F.col("df_within")).alias(
            "significance_score"
        ),
        "top_contributor",
        F.lit(None).cast("double").alias("correlation"),
    )


_PAIR_SUMS = (
    "a int, b int, n bigint, infinite bigint, sx double, sy double, sxx double, syy double, sxy double,"
    " min_x double, max_x double, min_y double, max_y double"
)
_ADDED = ("n", "infinite", "sx", "sy", "sxx", "syy", "sxy")
PAIR_STATE = (
    "column_a string, column_b string, shift_a double, shift_b double, n bigint, infinite bigint, sx double,"
    " sy double, sxx double, syy double, sxy double, min_x double, max_x double, min_y double, max_y double"
)
_PAIR = ["column_a", "column_b", "shift_a", "shift_b"]


def _matrix_sums(shifts: list[float]):
    """Sums of all pairs of columns over the rows complete for the pair, one row per pair and task.

    Matrix products over Arrow batches; values are taken relative to ``shifts`` so that large
    means lose no digits.  Infinite values stay out of the products, and the complete rows
    that hold one are counted: next to a gap they concern no pair.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width = len(shifts)
        a, b = np.triu_indices(width, 1)
        sums, least = np.zeros((7, width, width)), np.full((width, width), np.inf)
        most = -least
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there, infinite = ~np.isnan(x), np.isinf(x)
            x = x - shifts
            m, inf = there.astype(float), infinite.astype(float)
            v = np.where(there & ~infinite, x, 0.0)
            # Entry [i, j]: over the rows where i and j are present.
            sums += [m.T @ m, inf.T @ m + m.T @ inf, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v]
            for j in range(width):
                both = there & there[:, j : j + 1]
                least[:, j] = np.minimum(least[:, j], np.where(both, x, np.inf).min(axis=0, initial=np.inf))
                most[:, j] = np.maximum(most[:, j], np.where(both, x, -np.inf).max(axis=0, initial=-np.inf))
        n, infinite, sx, sy, sxx, syy, sxy = (s[a, b] for s in sums)
        columns = [
            a, b, n.astype(np.int64), infinite.astype(np.int64), sx, sy, sxx, syy, sxy,
            least[a, b], most[a, b], least[b, a], most[b, a],
        ]
        names = [f.split()[0] for f in _PAIR_SUMS.split(", ")]
        types = [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.float64()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def finite_means(df: DataFrame, measures: Sequence[str]) -> dict[str, float]:
    """Mean of the finite values of each column, 0 without any."""
    finite = [F.avg(F.when(is_finite(measure(df, m)), measure(df, m))) for m in measures]
    return {m: mean or 0.0 for m, mean in zip(measures, df.agg(*finite).first() if measures else [])}


def pair_sums(df: DataFrame, shifts: dict[str, float]) -> DataFrame:
    """What the correlations of all pairs of measures need; sums of several sets of rows add up.

    ``shifts`` names the measures in column order, with a value near the mean of each.
    """
    spark = df.sparkSession
    if len(shifts) < 2:
        return spark.createDataFrame([], PAIR_STATE)
    values = df.select(*[measure(df, m).alias(f"v{i}") for i, m in enumerate(shifts)])
    names, means = F.lit(list(shifts)), F.lit(list(map(float, shifts.values())))
    pick = lambda table, i, name: F.get(table, F.col(i)).alias(name)
    return _added_pairs(
        values.mapInArrow(_matrix_sums(list(shifts.values())), _PAIR_SUMS).select(
            pick(names, "a", "column_a"), pick(names, "b", "column_b"),
            pick(means, "a", "shift_a"), pick(means, "b", "shift_b"), "*",
        )
    )


def _added_pairs(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_PAIR).agg(
        *[F.sum(c).alias(c) for c in _ADDED],
        *[F.min(c).alias(c) for c in ("min_x", "min_y")],
        *[F.max(c).alias(c) for c in ("max_x", "max_y")],
    ).select(*[f.split()[0] for f in PAIR_STATE.split(", ")])


def merged_pairs(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Sums of two sets of rows, taken with the same shifts, as those of both."""
    return _added_pairs(earlier.unionByName(later))


def correlations_of_sums(sums: DataFrame) -> DataFrame:
    """Pearson correlation of each pair; pairs with fewer than two rows or a constant side are left out."""
    covariance = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread_x = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    spread_y = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.try_divide(covariance, F.sqrt(spread_x) * F.sqrt(spread_y))
    return sums.where("n >= 2 and min_x < max_x and min_y < max_y").select(
        "column_a",
        "column_b",
        "n",
        # Rounding may push a perfect correlation past 1; with an infinity there is none.
        F.when(F.col("infinite") > 0, F.lit(float("nan")))
        .otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
        .alias("correlation"),
    )


def correlations(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of measures over the rows complete for the pair."""
    return correlations_of_sums(pair_sums(df, finite_means(df, measures)))


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation over n pairs; two points always fit a line."""
    freedom = n - 2
    unexplained = (1 - r) * (1 + r)
    statistic = F.when(unexplained <= 0, F.lit(float("inf"))).otherwise(
        F.try_divide(r * r * freedom, unexplained)
    )
    return F.when(n == 2, F.lit(1.0)).otherwise(f_survival(statistic, F.lit(1), freedom))


def correlation_evidence(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Evidence rows for pairs of measures whose correlation is beyond the floor."""
    return _strong_pairs(correlations(df, measures))


def _strong_pairs(found: DataFrame) -> DataFrame:
    strong = found.where(
        is_finite(F.col("correlation")) & (F.abs("correlation") > CORRELATION_FLOOR)
    )
    return strong.select(
        "column_a",
        "column_b",
        F.lit("num_num").alias("rel_type"),
        F.abs("correlation").alias("strength_score"),
        correlation_p_value(F.col("correlation"), F.col("n")).alias("significance_score"),
        F.lit(None).cast("string").alias("top_contributor"),
        "correlation",
    )


def relationships(df: DataFrame, cubed: DataFrame, measures: Sequence[str]) -> DataFrame:
    """All pairwise evidence of a dataset."""
    return evidence_of_states(cubed, pair_sums(df, finite_means(df, measures)))


def evidence_of_states(cubed: DataFrame, sums: DataFrame) -> DataFrame:
    """The same from the cube and the sums of pairs, which both can be merged."""
    return category_evidence(cubed).unionByName(_strong_pairs(correlations_of_sums(sums)))


def list_relationships(evidence: DataFrame, minimum_strength: float = 0.0) -> DataFrame:
    """Evidence with at least the given strength, strongest first."""
    if not 0.0 <= minimum_strength <= 1.0:
        raise ValueError("minimum_strength must be between 0 and 1")
    return evidence.where(F.col("strength_score") >= minimum_strength).orderBy(
        F.desc("strength_score"), "column_a", "column_b"
    )
