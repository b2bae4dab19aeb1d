import numpy as np
import pandas as pd
import pytest

from factloom.llm.nearest import Index, _probed, adaptive_pairs, adaptive_scan, nearest
from tests.llm.common import MEDIUM, rows


def vectors(spark, data, ids=None):
    ids = range(len(data)) if ids is None else ids
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], "l", 0) for i, v in zip(ids, data)],
        "vec_id long, embedding array<float>, list_id string, part int",
    )


def exact(data, ids, query, k):
    x = np.array(data, np.float32).astype(float)
    score = {i: float((v * x[ids.index(query)]).sum()) for i, v in zip(ids, x) if i != query}
    return sorted(score.items(), key=lambda p: (-p[1], p[0]))[:k]


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(spark, data, ids, queries, **options):
    table = vectors(spark, data, ids)
    found = by_query(nearest(table, table.where(table.vec_id.isin(queries)), k=20, **options))
    hit = total = 0
    for q in queries:
        best = exact(data, ids, q, 20)
        hit += len({i for i, _ in found[q]} & {i for i, _ in best})
        total += len(best)
        scores = dict(exact(data, ids, q, len(ids)))
        assert all(s == pytest.approx(scores[i], abs=1e-12) for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
    return hit / total


def test_recall_on_the_table(spark):
    data = rows(f"SELECT vec_id, embedding FROM '{MEDIUM}/embeddings.parquet' ORDER BY vec_id")
    ids = [i for i, _ in data]
    assert recall(spark, [v for _, v in data], ids, [i for i in ids if i % 20 == 0]) >= 0.9


def test_recall_with_a_hot_list_and_uneven_norms(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((6, 24))
    data = centre[rng.integers(0, 6, 3000)] + 0.4 * rng.standard_normal((3000, 24))
    data *= rng.uniform(0.5, 2.0, (3000, 1))
    data[:1000] = data[0]  # a third of all rows are one vector
    ids = list(range(3000))
    data = data.astype(np.float32)
    assert recall(spark, data.tolist(), ids, list(range(0, 3000, 150))) >= 0.9


def test_recall_on_a_larger_table(spark):
    data = rows("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id")
    ids = [i for i, _ in data]
    assert recall(spark, [v for _, v in data], ids, [i for i in ids if i % 20 == 0]) >= 0.9


def test_recall_without_clusters(spark):
    data = np.random.default_rng(4).standard_normal((6000, 64)).astype(np.float32)
    assert recall(spark, data.tolist(), list(range(6000)), list(range(0, 6000, 200))) >= 0.9


def test_lists_that_hold_nothing_are_not_probed():
    rng = np.random.default_rng(6)
    centre = 40 * rng.standard_normal((8, 16))
    x = np.repeat(centre, 100, axis=0) + 0.1 * rng.standard_normal((800, 16))
    index = Index(16, float(np.sqrt((x**2).sum(axis=1)).max()), np.eye(17), np.empty((0, 17)), np.arange(800), x)
    index.centroids = np.array([index.lifted(x[i : i + 100]).mean(axis=0) for i in range(0, 800, 100)])
    away = np.sqrt(((x - index.flat_centroids().repeat(100, axis=0)) ** 2).sum(axis=1)).reshape(8, 100).max(axis=1)
    norms = np.sqrt((x**2).sum(axis=1)).reshape(8, 100).max(axis=1)
    asked = pd.DataFrame({"vec_id": range(0, 800, 50), "embedding": list(x[::50])})
    [probed] = _probed(index, np.full(8, 100), away, norms, 20)(iter([asked]))
    pairs = set(zip(probed["vec_id"], probed["list_id"]))
    for i in range(0, 800, 50):
        best = np.argsort(-(x @ x[i]), kind="stable")[:21]
        assert {(i, b // 100) for b in best if b != i} <= pairs
    assert len(pairs) < 8 * 16


def test_edge_cases(spark):
    data = [[1, 0], [0, 1], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [], [1, 0], [1, 0]]
    ids = [0, 20, 1, 2, 3, 4, 5, 6, 7, 8, None]
    table = vectors(spark, data, ids)
    found = by_query(nearest(table, table.where("vec_id % 20 = 0"), k=20))
    assert found == {0: [(8, 1.0), (20, 0.0)], 20: [(0, 0.0), (8, 0.0)]}
    assert nearest(vectors(spark, []), vectors(spark, [])).collect() == []
    twice = vectors(spark, [[1, 1], [1, 1], [2, 2]], [0, 0, 1])
    assert by_query(nearest(twice, twice.where("vec_id = 0"), k=5)) == {0: [(1, 4.0)]}


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 65))
    kept = hit = 0
    for q in rng.standard_normal((20, 65)) * 0.5:
        alive = adaptive_scan(x, q, 20)
        best = np.argsort(((x - q) ** 2).sum(axis=1))[:20]
        kept, hit = kept + len(alive), hit + len(np.intersect1d(alive, best))
    assert hit >= 0.97 * 400 and kept < 0.8 * 20 * 4000


def test_many_queries_at_once_find_what_lies_within():
    rng = np.random.default_rng(7)
    x, q = rng.normal(size=(400, 40)), rng.normal(size=(30, 40))
    d2 = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    within = np.sort(d2, axis=1)[:, 9]
    i, j = adaptive_pairs(x, q, within)
    found = set(zip(i.tolist(), j.tolist()))
    want = set(zip(*(c.tolist() for c in np.nonzero(d2 <= within[:, None] * (1 + 1e-9)))))
    assert len(want) == 300 and found <= want and len(found) >= 0.95 * 300
    # Without a column block left to test it is the exact comparison.
    exact = adaptive_pairs(x, q, within, block=64)
    assert set(zip(*(c.tolist() for c in exact))) == want
