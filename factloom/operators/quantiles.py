"""Exact quantiles of many columns without gathering the values anywhere.

Spark's own exact percentile keeps every distinct value of a column in one aggregation
state.  Here the wanted ranks are searched instead: each pass counts the values of the
current value range in buckets (combined on the map side, a few thousand
rows per column), picks the bucket that holds the rank and continues inside it, from
the smallest to the largest value really present.  A handful of passes ends at the value
itself whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from factloom.functions.columns import is_finite, measure

BUCKETS = 4096
#: Ranges whose ends differ by a larger factor, or in sign, are cut by magnitude.
SPREAD = 2.0**20


@dataclass
class _Range:
    """A value range of one column, the count of values below it, and ranks to find."""

    column: int
    low: float
    high: float
    below: int
    ranks: set[int] = field(default_factory=set)

    def entry(self, range_id: int) -> Column:
        """What `_bucket` has to know of this range."""
        wide = self.low <= 0 <= self.high or max(abs(self.low), abs(self.high)) > SPREAD * min(abs(self.low), abs(self.high))
        # Halving first keeps the width finite for values near the double limits.
        half = 0.5 if max(abs(self.low), abs(self.high)) > 1e300 else 1.0
        return _entry(range_id, self.low, wide, half, self.low * half, self.high * half - self.low * half)

    def holds_rank(self) -> str:
        """SQL text: one of the wanted ranks falls into the bucket of the row."""
        local = sorted(r - self.below for r in self.ranks)
        return " or ".join(f"(before <= {k} and before + n > {k})" for k in local)


def _entry(range_id: int, low: float, wide: bool, half: float, start: float, width: float) -> Column:
    values = {"id": range_id, "low": low, "wide": wide, "half": half, "start": start, "width": width}
    return F.struct(*[F.lit(x).alias(name) for name, x in values.items()])


#: Stands behind the last range of a column and holds nothing.
_NO_RANGE = (-1, math.inf, False, 1.0, 0.0, 1.0)


def _bucket(v: Column, r: Column) -> Column:
    """The bucket of a value in its range.

    Any rising function of the value will do.  A range of many magnitudes is cut by the
    binary logarithm, about one magnitude to a bucket; inside a magnitude equal widths
    resolve twelve of a double's 52 bits a pass.  So six passes suffice for any data.
    """
    magnitude = F.coalesce(F.signum(v) * (F.log2(F.abs(v)) + 1075.0) / 2100.0, F.lit(0.0))
    position = (v * r["half"] - r["start"]) / r["width"] * float(BUCKETS)
    place = F.when(r["wide"], (magnitude + 1.0) * (BUCKETS / 2)).otherwise(position)
    return F.least(F.floor(place).cast("int"), F.lit(BUCKETS - 1))


def bounds(value: Column, n: Column | None = None) -> Column:
    """What the search starts from: counts, and the smallest and largest finite value.

    ``n`` says how often each value stands for itself; once, if left out.
    """
    n = F.lit(1) if n is None else n
    total = lambda which: F.coalesce(F.sum(F.when(which, n)), F.lit(0))
    return F.struct(
        total(value.isNotNull()).alias("n"),
        total(value == float("-inf")).alias("below"),
        total(value == float("inf")).alias("above"),
        F.min(F.when(is_finite(value), value)).alias("low"),
        F.max(F.when(is_finite(value), value)).alias("high"),
    )


def exact_quantiles(
    df: DataFrame, names: Sequence[str], probabilities: Sequence[float], known: Sequence[Row] | None = None
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; None for a column without values.

    ``known`` gives the ``bounds`` of each column if they were computed already.
    """
    if not names:
        return {}
    values = df.select(*[measure(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    if known is None:
        known = values.agg(*[bounds(F.col(c)).alias(c) for c in values.columns]).first()

    def of_slots(slots: Sequence[int]) -> DataFrame:
        entries = ", ".join(f"struct({i} as slot, v{i} as v, 1L as n)" for i in slots)
        return values.selectExpr(f"inline(array({entries}))")

    return dict(zip(names, search(of_slots, known, probabilities)))


def search(
    of_slots: Callable[[Sequence[int]], DataFrame], known: Sequence[Row], probabilities: Sequence[float]
) -> list[list[float | None]]:
    """Quantiles of each slot; ``of_slots`` gives rows (slot, v, n) of some, ``known`` the bounds of all."""
    found: dict[tuple[int, int], float] = {}
    open_ranges: list[_Range] = []
    for i, b in enumerate(known):
        start = _Range(i, b["low"], b["high"], b["below"])
        for rank in {r for p in probabilities for r in _neighbours(b["n"], p)[:2]} if b["n"] else ():
            if rank < b["below"]:
                found[i, rank] = float("-inf")
            elif rank >= b["n"] - b["above"]:
                found[i, rank] = float("inf")
            else:
                start.ranks.add(rank)
        _settle(start, found, open_ranges)

    while open_ranges:
        open_ranges = _narrow(of_slots(sorted({r.column for r in open_ranges})), open_ranges, found)

    return [[_interpolate(found, i, b["n"], p) for p in probabilities] for i, b in enumerate(known)]


def _neighbours(n: int, p: float) -> tuple[int, int, float]:
    position = (n - 1) * p
    lower = math.floor(position)
    return lower, min(lower + 1, n - 1), position - lower


def _interpolate(found, column: int, n: int, p: float) -> float | None:
    if not n:
        return None
    lower, upper, share = _neighbours(n, p)
    a, b = found[column, lower], found[column, upper]
    if a == b or share == 0:
        return a
    # Taken from the nearer end, as numpy does, so that fences agree to the last bit.
    return a + (b - a) * share if share < 0.5 else b - (b - a) * (1 - share)


def _settle(candidate: _Range, found, open_ranges: list[_Range]) -> None:
    if not candidate.ranks:
        return
    if candidate.low == candidate.high:
        found.update({(candidate.column, r): candidate.low for r in candidate.ranks})
    else:
        open_ranges.append(candidate)


def _bucketed(values: DataFrame, ranges: list[_Range]) -> DataFrame:
    """(range_id, bucket, v, n): the values that lie in a range, with their buckets."""
    # Ranges of a column do not overlap.  They are looked up in one list, so that the code for a row
    # does not grow with columns and ranges: Java leaves long methods uncompiled.
    here = {c: [] for c in range(1 + max(r.column for r in ranges))}
    for i, r in sorted(enumerate(ranges), key=lambda x: x[1].low):
        here[r.column].append((i, r))
    most = max(len(h) for h in here.values())
    highs, entries = [], []
    for h in here.values():
        rest = most - len(h)
        highs += [r.high for _, r in h] + [math.inf] * rest
        entries += [r.entry(i) for i, r in h] + [_entry(*_NO_RANGE)] * (rest + 1)
    v, slot, highs = F.col("v"), F.col("slot"), F.lit(highs)
    passed = sum(((v > F.get(highs, slot * most + k)).cast("int") for k in range(most)), F.lit(0))
    return (
        values.where(v.isNotNull())
        .select("v", "n", F.get(F.array(*entries), slot * (most + 1) + passed).alias("r"))
        .where((F.col("r.id") >= 0) & (v >= F.col("r.low")))
        .select(F.col("r.id").alias("range_id"), _bucket(v, F.col("r")).alias("bucket"), "v", "n")
    )


def _narrow(values: DataFrame, ranges: list[_Range], found) -> list[_Range]:
    wanted = " or ".join(f"(range_id = {i} and ({r.holds_rank()}))" for i, r in enumerate(ranges))
    in_order = Window.partitionBy("range_id").orderBy("bucket")
    buckets = (
        _bucketed(values, ranges)
        .groupBy("range_id", "bucket")
        .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        # At most BUCKETS rows per range_id from here on.
        .withColumn("before", F.sum("n").over(in_order) - F.col("n"))
        .where(wanted)
        .collect()
    )

    still_open: list[_Range] = []
    for row in buckets:
        parent = ranges[row["range_id"]]
        below = parent.below + row["before"]
        inner = _Range(parent.column, row["low"], row["high"], below)
        for rank in parent.ranks:
            if rank == below and row["n"] > 0:
                found[parent.column, rank] = row["low"]
            elif rank == below + row["n"] - 1:
                found[parent.column, rank] = row["high"]
            elif below < rank < below + row["n"] - 1:
                inner.ranks.add(rank)
        _settle(inner, found, still_open)
    return still_open
