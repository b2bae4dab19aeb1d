"""What one task of the nearest-neighbour search holds at a time."""

import tracemalloc

import numpy as np
import pandas as pd

from factloom.llm import nearest as module
from factloom.llm.nearest import Index, _assigned, _probed, _scanned, nearest
from tests.llm.test_nearest import by_query, exact, vectors


def index_of(x, n_lists=1):
    d = x.shape[1]
    index = Index(d, float(np.sqrt((x**2).sum(axis=1)).max()), np.eye(d + 1), np.empty((0, d + 1)), np.arange(50), x[:50])
    index.centroids = index.lifted(x[:n_lists])
    return index


def frame(x, **more):
    return pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), **more})


def peak(work):
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_queries_of_many_lists_leave_in_small_frames():
    x = np.random.default_rng(1).standard_normal((1000, 8))
    index = index_of(x, 200)
    asked = frame(x)
    frames = list(_probed(index, np.full(200, 5), np.full(200, 99.0), np.full(200, 99.0), 3)(iter([asked])))
    assert max(map(len, frames)) <= module.PROBED_AT_ONCE
    pairs = set(zip(*(pd.concat(frames)[c] for c in ("vec_id", "list_id"))))
    assert pairs == {(i, c) for i in range(1000) for c in range(200)}


def test_a_list_that_many_queries_probe_takes_bounded_memory():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((1000, 16)), rng.standard_normal((6000, 16))
    index = index_of(x)
    asked = frame(q, least=-np.inf)
    asked["vec_id"] += 10_000
    asked["least"] = [np.partition(x @ v, -300)[-300] for v in q]
    # All pairs at once would be 48 MB, several times over.
    most, found = peak(lambda: _scanned(index, 5)(None, asked, frame(x)))
    assert most < 48e6
    product = q @ x.T
    for i in (0, 511, 512, 5999):
        best = np.argsort(-product[i], kind="stable")[:5]
        got = found[found["query_id"] == 10_000 + i]
        assert len(got) == 5 and len(set(got["vec_id"]) & set(best.tolist())) >= 4


def test_exact_products_are_taken_within_bounds():
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((300, 512)), rng.standard_normal((200, 512))
    i, j = rng.integers(0, 300, 60_000), rng.integers(0, 200, 60_000)
    # All pairs at once would be 245 MB three times.
    most, scores = peak(lambda: module._products(a, i, b, j))
    assert most < 3.5 * 8 * module.COMPONENTS_AT_ONCE
    assert np.allclose(scores, (a @ b.T)[i, j])


def test_lists_are_found_for_some_rows_at_a_time():
    x = np.random.default_rng(4).standard_normal((8000, 8))
    index = index_of(x, 500)
    # All distances at once would be 32 MB, several times over.
    most, [f] = peak(lambda: list(_assigned(index)(iter([frame(x)]))))
    assert most < 30e6
    assert f["list_id"].tolist() == np.argmin(index.distances(index.lifted(x)), axis=1).tolist()


def test_queries_are_split_by_their_number(spark, monkeypatch):
    """Few vectors in one list, which every query probes."""
    data = np.random.default_rng(5).standard_normal((600, 4)).astype(np.float32)
    table = vectors(spark, data.tolist())

    def sizes(index, k):
        def run(key, queries, vectors):
            return pd.DataFrame({"query_id": [hash(key)], "vec_id": [len(queries)], "score": [0.0]})

        return run

    monkeypatch.setattr(module, "QUERY_SEGMENT", 40)
    with monkeypatch.context() as m:
        m.setattr(module, "_scanned", sizes)
        held = [r["vec_id"] for r in nearest(table, table, k=1000, n_lists=1).collect()]
    assert sum(held) == 600 and max(held) <= 80
    found = by_query(nearest(table, table.where("vec_id % 50 = 0"), k=5, n_lists=1))
    ids = list(range(600))
    for q in range(0, 600, 50):
        assert [i for i, _ in found[q]] == [i for i, _ in exact(data.tolist(), ids, q, 5)]


def test_floats_are_shuffled_as_floats_and_doubles_as_doubles(spark):
    table = vectors(spark, [[1, 0], [0, 1], [1, 1]])
    assert "array<float>" in module._layout(module._kept_narrow(module.usable(table)))
    exact_ones = spark.createDataFrame([(0, [0.1, 0.7]), (1, [0.3, 0.2])], "vec_id long, embedding array<double>")
    assert "array<double>" in module._layout(module._kept_narrow(module.usable(exact_ones)))
    assert by_query(nearest(exact_ones, exact_ones.where("vec_id = 0"), k=5)) == {0: [(1, 0.1 * 0.3 + 0.7 * 0.2)]}
    whole = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, embedding array<int>")
    assert by_query(nearest(whole, whole.where("vec_id = 0"), k=5)) == {0: [(1, 11.0)]}
