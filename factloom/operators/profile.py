"""Statistical profile of every column: summary, outliers, histogram, top values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.functions.columns import col, is_finite, measure
from factloom.operators.catalog import SHORT_TEXT_BYTES, ColumnRole, numeric_counts
from factloom.operators.quantiles import bounds, exact_quantiles, search

BINS = 10
TOP_VALUES = 10
QUARTILES = (0.25, 0.5, 0.75)
FENCE = 1.5


@dataclass(frozen=True)
class Bins:
    """Equal-width bins of one column; plain numbers known before the counting pass."""

    edges: tuple[float, ...]

    @classmethod
    def spanning(cls, low: float, high: float) -> "Bins":
        if low == high:
            low, high = low - 0.5, high + 0.5
        step = (high - low) / BINS
        return cls(tuple([i * step + low for i in range(BINS)] + [high]))

    @property
    def labels(self) -> list[str]:
        # Fixed value: how a bin is labelled.
        return [f"{a:.1f}-{b:.1f}" for a, b in zip(self.edges, self.edges[1:])]


@dataclass(frozen=True)
class Summary:
    """Statistics of one numeric column.  There is one per column, so they are kept on the
    driver and enter the next pass as constants."""

    ordinal: int
    name: str
    value_count: int
    mean: float | None
    median: float | None
    min_val: float | None
    max_val: float | None
    std_dev: float | None
    q1: float | None
    q3: float | None
    bins: Bins | None


_SUMMARY = (
    "ordinal int, name string, value_count bigint, mean double, median double, min_val double,"
    " max_val double, std_dev double, q1 double, q3 double"
)
_TOP = "ordinal int, name string, value string, n bigint, rank int"
_COUNTS = "ordinal int, name string, outlier_count bigint, bin_counts array<bigint>"


def summarise(df: DataFrame, names: Sequence[str]) -> list[Summary]:
    """Mean, median, extremes, sample deviation, quartiles and bins of each column."""
    if not names:
        return []
    values = df.select(*[measure(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    basics = values.agg(
        *[
            F.struct(
                F.avg(v).alias("mean"),
                F.min(v).alias("min"),
                F.max(v).alias("max"),
                F.when(is_finite(F.stddev_samp(v)), F.stddev_samp(v)).alias("deviation"),
                bounds(v).alias("bounds"),
            )
            for v in (F.col(c) for c in values.columns)
        ]
    ).first()
    quantiles = exact_quantiles(df, names, QUARTILES, [b["bounds"] for b in basics])
    return [
        Summary(
            ordinal=df.columns.index(n),
            name=n,
            value_count=b["bounds"]["n"],
            mean=b["mean"],
            median=quantiles[n][1],
            min_val=b["min"],
            max_val=b["max"],
            std_dev=b["deviation"],
            q1=quantiles[n][0],
            q3=quantiles[n][2],
            bins=Bins.spanning(b["bounds"]["low"], b["bounds"]["high"])
            if b["bounds"]["low"] is not None
            else None,
        )
        for n, b in zip(names, basics)
    ]


def summarise_counts(values: DataFrame, columns: Sequence[tuple[int, str]]) -> list[Summary]:
    """The same from counted values (slot, v, n) of columns given as (ordinal, name).

    Every distinct value is one row however many rows of the dataset hold it.
    """
    if not columns:
        return []
    n, v = F.col("n"), F.col("v")
    found = {
        r["slot"]: r
        for r in values.groupBy("slot")
        .agg(
            (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
            bounds(v, n).alias("bounds"),
        )
        .collect()
    }
    means = F.lit([float(found[i]["mean"]) if i in found else None for i in range(len(columns))])
    apart = v - F.get(means.cast("array<double>"), F.col("slot"))
    squares = dict(
        values.groupBy("slot")
        .agg(F.try_divide(F.sum(n * apart * apart), F.sum(n) - 1).alias("variance"))
        .select("slot", F.when(is_finite(F.col("variance")), F.sqrt("variance")))
        .collect()
    )
    nothing = {"n": 0, "below": 0, "above": 0, "low": None, "high": None}
    known = [found[i]["bounds"].asDict() if i in found else nothing for i in range(len(columns))]
    quantiles = search(lambda slots: values.where(F.col("slot").isin(list(slots))), known, QUARTILES)
    summaries = []
    for i, (ordinal, name) in enumerate(columns):
        row, (q1, median, q3), low, high = found.get(i), quantiles[i], known[i]["low"], known[i]["high"]
        summaries.append(
            Summary(
                ordinal, name, known[i]["n"], row and row["mean"], median, row and row["min"], row and row["max"],
                squares.get(i), q1, q3, Bins.spanning(low, high) if low is not None else None,
            )
        )
    return summaries


def _as_rows(spark: SparkSession, summaries: list[Summary]) -> DataFrame:
    fields = [f.split()[0] for f in _SUMMARY.split(", ")]
    rows = [tuple(getattr(s, f) for f in fields) for s in summaries]
    return spark.createDataFrame(rows, _SUMMARY)


def numeric_summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The summaries as rows, one per column."""
    return _as_rows(df.sparkSession, summarise(df, names))


def distribution_counts(df: DataFrame, summaries: list[Summary]) -> DataFrame:
    """Outliers and histogram counts of all numeric columns in one more pass."""
    filled = [s for s in summaries if s.value_count]
    if not filled:
        return df.sparkSession.createDataFrame([], _COUNTS)
    values = df.select(*[measure(df, s.name).alias(f"v{i}") for i, s in enumerate(filled)])
    entries = [
        F.struct(F.lit(i).alias("slot"), F.col(f"v{i}").alias("v"), F.lit(1).alias("n")) for i in range(len(filled))
    ]
    long = values.select(F.inline(F.array(*entries))).where(F.col("v").isNotNull())
    return _distribution(long, list(enumerate(filled)))


def _distribution(values: DataFrame, columns: list[tuple[int, Summary]]) -> DataFrame:
    """Outliers and histogram counts of rows (slot, v, n); columns as (slot, summary)."""
    v, n, slot = F.col("v"), F.col("n"), F.col("slot")
    known = dict(columns)
    listed = [known.get(i) for i in range(1 + max(known))]

    def of_slot(value: Callable[[Summary], object], type_: str) -> Column:
        return F.get(F.lit([s and value(s) for s in listed]).cast(f"array<{type_}>"), slot)

    # Fences and edges are looked up in lists, so that the code for a row does not grow with the
    # columns: Java leaves long methods uncompiled.
    is_outlier = (v < of_slot(lambda s: s.q1 - FENCE * (s.q3 - s.q1), "double")) | (
        v > of_slot(lambda s: s.q3 + FENCE * (s.q3 - s.q1), "double")
    )
    inner = [e for s in listed for e in (s.bins.edges[1:-1] if s and s.bins else [None] * (BINS - 1))]
    inner = F.lit(inner).cast("array<double>")
    # The bin of a value is the number of inner edges it reaches; without edges there is none.
    reached = sum(((v >= F.get(inner, slot * (BINS - 1) + k)).cast("int") for k in range(BINS - 1)), F.lit(0))
    total = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0)).cast("bigint")
    return (
        values.select("slot", is_outlier.alias("is_outlier"), F.when(is_finite(v), reached).alias("bin"), "n")
        .groupBy("slot", "is_outlier", "bin")
        .agg(F.sum("n").alias("n"))
        # At most 2 * (BINS + 1) rows per column from here on.
        .groupBy("slot")
        .agg(
            total(F.col("is_outlier")).alias("outlier_count"),
            F.array(*[total(F.col("bin") == b) for b in range(BINS)]).alias("bin_counts"),
        )
        .select(
            of_slot(lambda s: s.ordinal, "int").alias("ordinal"),
            of_slot(lambda s: s.name, "string").alias("name"),
            "outlier_count",
            "bin_counts",
        )
    )


def iqr_outliers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values beyond 1.5 interquartile ranges from the quartiles, counted per column."""
    summaries = summarise(df, names)
    counts = distribution_counts(df, summaries).select("ordinal", "outlier_count")
    return (
        _as_rows(df.sparkSession, summaries)
        .join(counts, "ordinal", "left")
        .select("name", "q1", "q3", F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"))
    )


def histogram(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Ten equal-width bins per column, one row per bin, empty bins included."""
    summaries = summarise(df, names)
    return (
        distribution_counts(df, summaries)
        .join(_edges(df.sparkSession, summaries), "name")
        .select("name", F.posexplode(F.arrays_zip("lo", "hi", "label", "bin_counts")).alias("bin", "b"))
        .select("name", "bin", "b.lo", "b.hi", "b.label", F.col("b.bin_counts").alias("n"))
    )


def _edges(spark: SparkSession, summaries: list[Summary]) -> DataFrame:
    return spark.createDataFrame(
        [
            (s.name, list(s.bins.edges[:-1]), list(s.bins.edges[1:]), s.bins.labels)
            for s in summaries
            if s.bins
        ],
        "name string, lo array<double>, hi array<double>, label array<string>",
    )


def top_values(df: DataFrame, names: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """Most frequent values of each column; equal counts are ordered by value."""
    if not names:
        return df.sparkSession.createDataFrame([], _TOP)
    slots = [str(i) for i in range(len(names))]
    slot = F.col("slot").cast("int")
    counted = (
        df.select(*[col(n).cast("string").alias(s) for n, s in zip(names, slots)])
        .unpivot([], slots, "slot", "value")
        .where(F.col("value").isNotNull())
        .groupBy("slot", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ordinal", F.get(F.lit([df.columns.index(n) for n in names]), slot))
        .withColumn("name", F.get(F.lit(list(names)), slot))
    )
    return _most_frequent(counted, k)


def _most_frequent(counted: DataFrame, k: int) -> DataFrame:
    by_count = Window.partitionBy("ordinal", "name").orderBy(F.desc("n"), "value")
    return (
        counted.withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= k)
        .select("ordinal", "name", "value", "n", "rank")
    )


def long_texts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ordinal, digest, value): the distinct texts that value counts know by their digest."""
    entries = [
        F.struct(F.lit(df.columns.index(n)).alias("ordinal"), col(n).cast("string").alias("value")) for n in names
    ]
    return (
        df.select(F.inline(F.array(*entries)))
        .where(F.octet_length("value") > SHORT_TEXT_BYTES)
        .distinct()
        .select("ordinal", F.sha2("value", 256).alias("digest"), "value")
    )


def top_counts(counted: DataFrame, columns: Sequence[tuple[int, str]], texts: DataFrame | None = None, k: int = TOP_VALUES) -> DataFrame:
    """`top_values` from value counts; ``texts`` spells out the long ones, see `long_texts`."""
    ordinals = [o for o, _ in columns]
    names = F.create_map(*[F.lit(x) for pair in columns for x in pair])
    rows = counted.where(F.col("ordinal").isin(ordinals) & F.col("as_text").isNotNull()).select(
        "ordinal", names[F.col("ordinal")].alias("name"), F.col("as_text").alias("value"), "n"
    )
    if texts is not None:
        spelled = texts.distinct().select("ordinal", F.col("digest").alias("value"), F.col("value").alias("spelled"))
        rows = rows.join(spelled, ["ordinal", "value"], "left").withColumn(
            "value", F.coalesce("spelled", "value")
        ).drop("spelled")
    return _most_frequent(rows, k)


def column_profile(df: DataFrame, roles: list[ColumnRole]) -> DataFrame:
    """One row per flat column with all statistics and its distribution."""
    numeric = [r.name for r in roles if r.business_type == "NUMERIC"]
    categorical = [r.name for r in roles if r.business_type == "CATEGORICAL"]
    summaries = summarise(df, numeric)
    return _profile_rows(
        df.sparkSession, roles, summaries, distribution_counts(df, summaries), top_values(df, categorical)
    )


def profile_of_counts(counted: DataFrame, roles: list[ColumnRole], texts: DataFrame | None = None) -> DataFrame:
    """The same from value counts with every slot, without the rows themselves."""
    numeric = [(r.ordinal, r.name) for r in roles if r.business_type == "NUMERIC"]
    categorical = [(r.ordinal, r.name) for r in roles if r.business_type == "CATEGORICAL"]
    spark = counted.sparkSession
    values = numeric_counts(counted, [o for o, _ in numeric])
    summaries = summarise_counts(values, numeric)
    filled = [(i, s) for i, s in enumerate(summaries) if s.value_count]
    shape = _distribution(values, filled) if filled else spark.createDataFrame([], _COUNTS)
    top = top_counts(counted, categorical, texts) if categorical else spark.createDataFrame([], _TOP)
    return _profile_rows(spark, roles, summaries, shape, top)


def _profile_rows(
    spark: SparkSession, roles: list[ColumnRole], summaries: list[Summary], shape: DataFrame, top: DataFrame
) -> DataFrame:
    counts = spark.createDataFrame(
        [
            (r.ordinal, r.name, r.unique_count, r.row_count - r.non_null_count)
            for r in roles
            if r.business_role
        ],
        "ordinal int, name string, unique_count bigint, null_count bigint",
    )
    bars = shape.join(_edges(spark, summaries), "name", "left").select(
        "ordinal",
        "outlier_count",
        F.when(
            F.col("label").isNotNull(),
            F.struct(F.col("label").alias("labels"), F.col("bin_counts").alias("values")),
        ).alias("bars"),
    )
    ranked = (
        # At most TOP_VALUES entries per column.
        top.groupBy("ordinal")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
        .select(
            "ordinal",
            F.struct(F.col("top.value").alias("labels"), F.col("top.n").alias("values")).alias("tops"),
        )
    )
    return (
        counts.join(_as_rows(spark, summaries).drop("name"), "ordinal", "left")
        .join(bars, "ordinal", "left")
        .join(ranked, "ordinal", "left")
        .select(
            "ordinal",
            "name",
            "mean",
            "median",
            "min_val",
            "max_val",
            "std_dev",
            "unique_count",
            "null_count",
            F.coalesce("outlier_count", F.lit(0).cast("bigint")).alias("outlier_count"),
            F.coalesce("bars", "tops").alias("distribution"),
        )
    )
