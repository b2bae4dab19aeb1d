"""Tail probabilities for the two significance tests.

They run on result tables with one row per pair of columns, never on data rows.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

# The functions travel inside the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _stirling_rest(z: float) -> float:
    """ln Gamma(z) minus its leading Stirling terms."""
    if z < 12.0:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + _HALF_LOG_2PI)
    inv, inv2 = 1.0 / z, 1.0 / (z * z)
    return inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188))))


def _log_minus(ratio: float, u: float) -> float:
    """log(ratio) - u for ratio = 1 + u, exact both near ratio 1 and near ratio 0."""
    if abs(u) > 0.05:
        return math.log(ratio) - u
    total, power = 0.0, u
    for k in range(2, 40):
        power *= -u
        step = power / k
        total += step
        if abs(step) <= 1e-18 * abs(total):
            break
    return total


def beta_tail(x: float, y: float, a: float, b: float) -> float | None:
    """Regularised incomplete beta I_x(a, b); the caller gives y = 1 - x exactly.

    The power term is written through the distance from the mode, which keeps full
    precision for the very large degrees of freedom of long tables.
    """
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        rest = beta_tail(y, x, b, a)
        return None if rest is None else 1.0 - rest
    gap = x * b - y * a
    log_power = (
        a * _log_minus(x * ((a + b) / a), gap / a)
        + b * _log_minus(y * ((a + b) / b), -gap / b)
        + 0.5 * (math.log(a) - math.log(a + b) + math.log(b))
        - _HALF_LOG_2PI
        + _stirling_rest(a + b)
        - _stirling_rest(a)
        - _stirling_rest(b)
    )
    # Continued fraction by the modified Lentz recurrence.
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 200 + 20 * int(math.sqrt(max(a, b)))):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    else:
        return None  # not settled: no value is better than a rough one
    return math.exp(log_power) * value / a


def f_upper_tail(f: float, df1: float, df2: float) -> float | None:
    """P(F > f); None where the statistic itself is undefined."""
    if f is None or df1 is None or df2 is None:
        return None
    if math.isnan(f) or not df1 > 0 or not df2 > 0:
        return None
    if math.isinf(f):
        return 0.0
    scale = df2 + df1 * f
    return beta_tail(df2 / scale, df1 * f / scale, df2 / 2.0, df1 / 2.0)


def f_survival(statistic: Column, df1: Column, df2: Column) -> Column:
    """Upper tail of the F distribution as a column."""

    @F.pandas_udf("double")
    def upper_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series(
            [f_upper_tail(*row) for row in zip(f, d1, d2)], dtype="float64"
        )

    return upper_tail(statistic.cast("double"), df1.cast("double"), df2.cast("double"))
