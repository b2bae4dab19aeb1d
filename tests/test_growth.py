"""What a pass over the value counts of a growing dataset costs."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import catalog, profile, quantiles

#: Methods with more bytecode are never compiled by Java and run many times slower.
LONGEST = 8000


@pytest.fixture
def longest_method(spark):
    def of(df):
        tools = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        parts = tools.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield of
    spark.conf.set("spark.sql.adaptive.enabled", before)


def counted(spark, columns):
    return spark.range(40).select(
        (F.col("id") % columns).cast("int").alias("slot"), (F.col("id") / 3).alias("v"), F.lit(2).cast("bigint").alias("n")
    )


def test_code_of_a_quantile_pass_does_not_grow_with_the_columns(spark, longest_method):
    ranges = [quantiles._Range(c, 10.0 * k, 10.0 * k + 5, 0, {1}) for c in range(12) for k in range(6)]
    found = quantiles._bucketed(counted(spark, 12), ranges).groupBy("range_id", "bucket").agg(F.sum("n"))
    assert longest_method(found) < LONGEST


def test_code_of_the_histograms_does_not_grow_with_the_columns(spark, longest_method):
    bins = profile.Bins.spanning(0.0, 20.0)
    summaries = [profile.Summary(i, f"c{i}", 9, 1.0, 1.0, 0.0, 20.0, 1.0, 2.0, 5.0, bins) for i in range(12)]
    assert longest_method(profile._distribution(counted(spark, 12), list(enumerate(summaries)))) < LONGEST


def test_histograms_by_list(spark):
    """Columns with other fences and bins, one without a finite value, one that is not asked for."""
    rows = [(0, 0.0, 3), (0, 10.0, 1), (0, 99.0, 2), (1, float("inf"), 4), (2, 5.0, 7), (3, -5.0, 1), (3, 5.0, 1)]
    values = spark.createDataFrame(rows, "slot int, v double, n bigint")
    of = lambda i, q1, q3, bins: profile.Summary(i + 10, f"c{i}", 9, 1.0, 1.0, 0.0, 1.0, 1.0, q1, q3, bins)
    columns = [
        (0, of(0, 0.0, 10.0, profile.Bins.spanning(0.0, 99.0))),
        (1, of(1, float("inf"), float("inf"), None)),
        (3, of(3, -5.0, 5.0, profile.Bins.spanning(-5.0, 5.0))),
    ]
    shape = profile._distribution(values.where("slot <> 2"), columns)
    got = {r["ordinal"]: (r["name"], r["outlier_count"], r["bin_counts"]) for r in shape.collect()}
    assert got[10] == ("c0", 2, [3, 1, 0, 0, 0, 0, 0, 0, 0, 2])
    assert got[13] == ("c3", 0, [1, 0, 0, 0, 0, 0, 0, 0, 0, 1])
    assert got[11][2] == [0] * 10 and set(got) == {10, 11, 13}


WHAT = "id % 3 as k, if(id % 4 = 0, null, id / 2) as x, concat('t', id % 5) as t, id % 2 = 0 as f, cast(id % 7 as decimal(9, 2)) as d"


@pytest.mark.parametrize("apart", [True, False])
def test_new_rows_meet_earlier_counts_before_the_shuffle(spark, tmp_path, apart):
    def rows(a, b, name):
        df = spark.sql(f"select {WHAT} from range({a}, {b})")
        if not apart:
            return df
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first, second, both = rows(0, 40, "a"), rows(40, 100, "b"), rows(0, 100, "c")
    catalog.stored_counts(catalog.value_counts(first)).write.parquet(str(tmp_path / "counts"))
    earlier = spark.read.parquet(str(tmp_path / "counts"))
    merged = catalog.value_counts(second, earlier)
    whole = catalog.stored_counts(catalog.value_counts(both))
    assert sorted(map(str, catalog.stored_counts(merged).collect())) == sorted(map(str, whole.collect()))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    # One shuffle for all that is known of a column.
    assert plan.count("Exchange hashpartitioning") == (len(first.columns) if apart else 1)


def test_a_small_table_is_read_once_and_a_large_one_by_columns(spark, tmp_path, monkeypatch):
    spark.sql(f"select {WHAT} from range(60)").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    once = catalog.column_catalog(stored)
    assert scans(once) == 1
    monkeypatch.setattr(catalog, "ONE_PASS_BYTES", 0)
    apart = catalog.column_catalog(stored)
    assert scans(apart) == len(stored.columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
