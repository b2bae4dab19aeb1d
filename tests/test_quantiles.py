import random

import numpy as np
import pytest

from factloom.operators.quantiles import exact_quantiles

P = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def check(spark, values, parts=5):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
    got = exact_quantiles(df, ["v"], P)["v"]
    clean = [v for v in values if v is not None and v == v]
    assert got == [float(q) for q in np.quantile(clean, P)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_numpy(spark, seed):
    rng = random.Random(seed)
    check(spark, [rng.gauss(0, 10**seed) for _ in range(3000)])


def test_hot_value_and_outliers(spark):
    rng = random.Random(7)
    values = [5.0] * 2000 + [rng.uniform(4.99, 5.01) for _ in range(2000)] + [1e12, -1e15, None, float("nan")]
    check(spark, values)


def test_spread_over_many_magnitudes(spark):
    check(spark, [2.0**e for e in range(-300, 300)] + [-(3.0**e) for e in range(-100, 100)])


def test_limits_of_the_double_range(spark):
    check(spark, [-1.7e308, 1.7e308, 0.0, 1.0, 2.0] * 20)


def test_single_and_no_value(spark):
    df = spark.createDataFrame([(3.0, None), (None, None)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got == {"a": [3.0], "b": [None]}


def test_infinite_values_keep_their_rank(spark):
    df = spark.createDataFrame([(float("inf"),), (1.0,), (2.0,), (float("-inf"),), (3.0,)], "v double")
    assert exact_quantiles(df, ["v"], [0.0, 0.5, 1.0])["v"] == [float("-inf"), 2.0, float("inf")]


def test_values_of_all_magnitudes_take_six_passes(spark, monkeypatch):
    from factloom.operators import quantiles

    rng = random.Random(9)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(3000)]
    values += [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] + [1.0 + i * 2.0**-52 for i in range(200)]
    passes = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    probabilities = [0.1, 0.5, 0.9]
    got = exact_quantiles(df, ["v"], probabilities)["v"]
    assert got == [float(q) for q in np.quantile(values, probabilities)]
    assert len(passes) <= 6
