import math
import random

import numpy as np
import pytest

from factloom.functions.distributions import beta_tail, f_upper_tail
from factloom.operators import cube, relationships as rel


def evidence(spark, rows):
    df = spark.createDataFrame(rows, "d string, m double")
    return rel.category_evidence(cube.cube(df, ["d"], ["m"])).first()


def test_single_group(spark):
    got = evidence(spark, [("a", 1.0), ("a", 2.0)])
    assert (got["strength_score"], got["significance_score"]) == (0.0, None)


def test_singletons_have_strength_but_no_p_value(spark):
    got = evidence(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)])
    assert got["strength_score"] == pytest.approx(0.5)
    assert got["significance_score"] is None


def test_equal_means_go_to_the_first_key(spark):
    assert evidence(spark, [("c", 2.0), ("b", 2.0), ("a", 1.0)])["top_contributor"] == "b"


def test_strength_is_capped_and_infinite_is_zero(spark):
    assert evidence(spark, [("a", -10.0), ("b", 10.1)])["strength_score"] == 1.0
    assert evidence(spark, [("a", float("inf")), ("b", 1.0)])["strength_score"] == 0.0


def test_no_variance_within_groups(spark):
    assert evidence(spark, [("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)])["significance_score"] == 0.0
    assert evidence(spark, [("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)])["significance_score"] is None


def test_anova_drops_single_row_groups(spark):
    rng = random.Random(5)
    rows = [(k, rng.gauss(i, 2)) for i, k in enumerate("abc") for _ in range(9)] + [("z", 500.0)]
    df = spark.createDataFrame(rows, "d string, m double")
    got = rel.anova(rel.group_stats(cube.cube(df, ["d"], ["m"]))).first()
    groups = [[v for k, v in rows if k == g] for g in "abc"]
    everything = [v for g in groups for v in g]
    mean = sum(everything) / 27
    between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups)
    within = sum((v - sum(g) / len(g)) ** 2 for g in groups for v in g)
    assert got["f_statistic"] == pytest.approx((between / 2) / (within / 24), rel=1e-12)
    assert (got["df_between"], got["df_within"]) == (2, 24)


def test_correlation_is_pairwise_complete_and_skips_constants(spark):
    rows = [(1.0, 2.0, 7.0), (2.0, 4.1, 7.0), (3.0, 5.9, 7.0), (None, 1.0, 7.0), (9.0, None, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, flat double")
    got = rel.correlations(df, ["a", "b", "flat"]).collect()
    assert [(r["column_a"], r["column_b"], r["n"]) for r in got] == [("a", "b", 3)]
    assert got[0]["correlation"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1], rel=1e-12)


def test_two_points_and_perfect_lines(spark):
    two = spark.createDataFrame([(1.0, 5.0), (2.0, 3.0)], "a double, b double")
    got = rel.correlation_evidence(two, ["a", "b"]).first()
    assert got["significance_score"] == 1.0
    assert (got["strength_score"], got["correlation"]) == (pytest.approx(1.0), pytest.approx(-1.0))
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    assert rel.correlation_evidence(line, ["a", "b"]).first()["significance_score"] == pytest.approx(0.0, abs=1e-12)


def test_weak_correlations_are_dropped_and_listing_filters(spark):
    rows = [(1.0, 1.0), (2.0, -1.0), (3.0, 1.0), (4.0, -1.0), (5.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert rel.correlation_evidence(df, ["a", "b"]).count() == 0
    with pytest.raises(ValueError):
        rel.list_relationships(df, 1.5)


# Published upper critical values of the F distribution.
@pytest.mark.parametrize(
    "f, d1, d2, p",
    [(4.9646, 1, 10, 0.05), (3.4928, 2, 20, 0.05), (2.5336, 4, 30, 0.06130), (10.0443, 1, 10, 0.01),
     (161.4476, 1, 1, 0.05), (2.3719, 4, 1e9, 0.05), (3.8415, 1, 1e12, 0.05)],
)
def test_upper_tail_against_tables(f, d1, d2, p):
    tolerance = 2e-4 if p != 0.06130 else 2e-3
    assert f_upper_tail(f, d1, d2) == pytest.approx(p, abs=tolerance)


def test_incomplete_beta_against_closed_forms():
    for x in (0.001, 0.2, 0.5, 0.77, 0.999):
        assert beta_tail(x, 1 - x, 1.0, 1.0) == pytest.approx(x, rel=1e-13)
        assert beta_tail(x, 1 - x, 3.0, 1.0) == pytest.approx(x**3, rel=1e-12)
        # Binomial tail: P(at least 4 of 9).
        tail = sum(math.comb(9, k) * x**k * (1 - x) ** (9 - k) for k in range(4, 10))
        assert beta_tail(x, 1 - x, 4.0, 6.0) == pytest.approx(tail, rel=1e-11)


def test_upper_tail_at_the_edges():
    assert f_upper_tail(float("inf"), 2, 3) == 0.0
    assert f_upper_tail(float("nan"), 2, 3) is None
    assert f_upper_tail(0.0, 2, 3) == 1.0
    assert f_upper_tail(1e6, 3, 1e6) == 0.0
    # Both degrees of freedom large: half of the mass lies near 1.
    assert f_upper_tail(1.0, 1e8, 1e8) == pytest.approx(0.5, abs=1e-6)


def test_far_tails_do_not_break():
    for f in (1e3, 1e9, 1e17, 1e40, 1e200):
        for d1, d2 in ((1, 3), (1, 2), (4, 60), (1499, 58000)):
            assert 0.0 <= f_upper_tail(f, d1, d2) < 0.05
            assert 0.95 < f_upper_tail(1 / f, d2, d1) <= 1.0


def test_forty_measures_with_gaps_and_large_means(spark):
    """All pairs from one pass, each over its own complete rows."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 40)) + 1e9
    x[:, 1] = x[:, 0] * 2 + rng.standard_normal(400)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 39] = 5.0
    names = [f"m{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names))
    found = {(r["column_a"], r["column_b"]): (r["n"], r["correlation"]) for r in rel.correlations(df.repartition(5), names).collect()}
    assert len(found) == 39 * 38 // 2
    for (a, b), (n, r) in found.items():
        i, j = names.index(a), names.index(b)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert n == both.sum() and abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6
