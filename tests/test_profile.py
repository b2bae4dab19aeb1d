import random

import numpy as np

from factloom.operators import profile
from factloom.operators.catalog import collect_roles, column_catalog, semantic_roles


def test_constant_column_fills_the_middle_bin(spark):
    df = spark.createDataFrame([(5.0,)] * 3, "x double")
    bins = {r["bin"]: r for r in profile.histogram(df, ["x"]).collect()}
    assert (bins[0]["lo"], bins[9]["hi"]) == (4.5, 5.5)
    assert [bins[i]["n"] for i in range(10)] == [0, 0, 0, 0, 0, 3, 0, 0, 0, 0]


def test_bin_edges(spark):
    df = spark.createDataFrame([(i / 10,) for i in range(11)], "x double")
    counts = [r["n"] for r in sorted(profile.histogram(df, ["x"]).collect(), key=lambda r: r["bin"])]
    assert counts == [1, 1, 2, 0, 1, 2, 1, 0, 1, 2]


def test_histogram_equal_to_numpy(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(-50, 80), 1) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = sorted(profile.histogram(df, ["x"]).collect(), key=lambda r: r["bin"])
    counts, edges = np.histogram(values, bins=10)
    assert [r["n"] for r in rows] == counts.tolist()
    assert [r["lo"] for r in rows] + [rows[-1]["hi"]] == edges.tolist()
    assert [r["label"] for r in rows] == [f"{a:.1f}-{b:.1f}" for a, b in zip(edges, edges[1:])]


def test_infinities_stay_out_of_the_bins(spark):
    df = spark.createDataFrame([(float("inf"),), (0.0,), (10.0,)], "x double")
    assert sum(r["n"] for r in profile.histogram(df, ["x"]).collect()) == 2


def test_outliers_are_strictly_beyond_the_fences(spark):
    # Quartiles 2 and 4: fences at -1 and 7.
    df = spark.createDataFrame([(v,) for v in (-1.0, 2.0, 2.0, 3.0, 3.0, 4.0, 4.0, 7.0)], "x double")
    row = profile.iqr_outliers(df, ["x"]).first()
    q1, q3 = np.quantile([-1, 2, 2, 3, 3, 4, 4, 7], [0.25, 0.75])
    assert (row["q1"], row["q3"]) == (q1, q3)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert row["outlier_count"] == sum(v < low or v > high for v in (-1, 2, 2, 3, 3, 4, 4, 7))


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacd"] + [(None,)], "x string")
    rows = sorted(profile.top_values(df, ["x"], 3).collect(), key=lambda r: r["rank"])
    assert [(r["value"], r["n"]) for r in rows] == [("a", 2), ("b", 2), ("c", 1)]


def test_profile_of_every_kind_of_column(spark):
    rows = [(1.0, None, "a", True, [1]), (1.0, None, "a", False, [2]), (4.0, None, None, True, None)]
    df = spark.createDataFrame(rows, "v double, empty double, c string, flag boolean, nested array<int>")
    roles = collect_roles(semantic_roles(column_catalog(df)))
    got = {r["name"]: r for r in profile.column_profile(df, roles).collect()}
    assert set(got) == {"v", "empty", "c", "flag"}
    assert (got["v"]["mean"], got["v"]["median"]) == (2.0, 1.0)
    assert got["empty"]["mean"] is None and got["empty"]["distribution"] is None
    assert got["empty"]["null_count"] == 3 and got["empty"]["outlier_count"] == 0
    assert list(got["c"]["distribution"]["labels"]) == ["a"]
    assert abs(got["flag"]["mean"] - 2 / 3) < 1e-12
    assert sum(got["flag"]["distribution"]["values"]) == 3
