import math

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import hard_negatives as hn
from tests.llm.common import plain

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, anchors, positives=5, negatives=3):
    """Rows are (id, label, integer vector), one per id."""
    out = []
    for a, label, v in rows:
        if a not in anchors:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w)), i, other == label)
            for i, other, w in rows
            if i != a and len(w) == len(v)
        ]
        scored.sort()
        for s, p, _ in [t for t in scored if t[2]][:positives]:
            band = [t for t in scored if not t[2] and -50 * s <= -100 * t[0] <= -95 * s]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i, _) in enumerate(band[:negatives])]
    return sorted(out)


def found(spark, data, every=3, schema=SCHEMA, **options):
    df = spark.createDataFrame(data, schema)
    return plain(hn.hard_negatives(df, F.col("vec_id") % every == 0, F.col("__label"), **options))


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for low, high, d in ((-140, 140, 64), (-3, 9, 7), (0, 1, 1), (5, 6, 3), (-hn.MOST, hn.MOST, 33), (-40_000, 40_000, 16)):
        a, r = rng.integers(low, high, (9, d)), rng.integers(low, high, (23, d))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in r] for p in a]
        assert hn.packed_products(a, r).tolist() == want
    assert hn.packed_products(np.zeros((2, 0), int), np.zeros((3, 0), int)).tolist() == [[0] * 3] * 2
    # Several candidates share a word at the given vectors' size.
    assert hn.MANTISSA // (64 * 280 * 280).bit_length() == 2


def test_equals_all_pairs_with_ties_and_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, (rng.integers(-6, 7, 5) / 8).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    data += [(i, data[0][1], int(i % 3)) for i in range(150, 220)]  # a hot vector
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in data]
    want = brute(rows, set(range(0, 220, 3)))
    assert want and found(spark, data) == want
    monkeypatch.setattr(hn, "TILE", 64)
    monkeypatch.setattr(hn, "ROW_COMPONENTS", 200)
    monkeypatch.setattr(hn, "ANCHOR_COMPONENTS", 100)
    assert found(spark, data) == want


def test_rows_that_take_no_part(spark):
    good = [(3, [1.0, 0.5], 1), (4, [1.0, 0.25], 1), (5, [0.75, 0.25], 2), (7, [0.5, 0.5], 2)]
    bad = [
        (None, [1.0, 0.5], 1), (8, None, 1), (10, [1.0, 0.5], None), (11, [1.0, None], 1),
        (13, [float("nan"), 1.0], 2), (14, [float("inf"), 1.0], 2), (16, [1e30, 0.0], 2),
    ]
    want = brute([(i, n, [math.floor(256 * x) for x in v]) for i, v, n in good], {3})
    assert want and found(spark, good + bad) == want
    # Other lengths and empty vectors meet only their like; a repeated row counts once.
    assert found(spark, good + bad + good + [(17, [1.0], 2), (19, [], 1), (6, [], 1), (9, [], 2)]) == sorted(
        want + [(6, 19, 1, 9, 0, 0)]
    )
    assert found(spark, []) == [] and found(spark, bad) == []
    clashing = [(*row, 1, 2, 3) for row in good]
    assert found(spark, clashing, schema=SCHEMA + ", v int, row_block int, __label int") == want


def test_an_id_with_two_vectors_counts_as_the_smaller(spark):
    data = [(3, [1.0], 1), (4, [1.0], 1), (4, [0.5], 1), (5, [0.75], 2), (5, [9.0], 3)]
    rows = [(3, 1, [256]), (4, 1, [128]), (5, 2, [192])]
    assert found(spark, data) == brute(rows, {3})
