"""Nearest neighbours by largest inner product with an adaptive dimension scan.

Vectors are assigned to lists around centroids.  A query probes every list that may hold one
of its k largest products, by the list's radius and norms against the k-th product of a sample.
Inside a probed list vectors lie rotated in
blocks of columns; after each block a hypothesis test on the partial distance abandons the
candidates that are unlikely to reach the query's current k-th distance.  Survivors are
ranked by the exact inner product of the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import written

#: Rows that the centroids are fitted on, taken in the order of a hash of the id.
FIT_ROWS = 20_000
#: At most so many lists; their number and sizes are known to the driver.
MAX_LISTS = 1024
#: Vectors of a list and queries that one group holds at most, about; more are split.
SEGMENT, QUERY_SEGMENT = 4096, 8192
#: Queries multiplied by the sample at a time, and rows by the centroids or a group's vectors.
BOUND_QUERIES, ROWS_AT_ONCE = 256, 512
#: Rows with a query and a list that leave a task's Python at a time.
PROBED_AT_ONCE = 8192
COLUMN_BLOCK = 16
#: Share of pairs below which single pairs are cheaper than a matrix product.
SPARSE = 0.05
#: Components of the pairs whose exact products are taken at a time.
COMPONENTS_AT_ONCE = 1 << 20
#: Width of the test: the larger, the fewer true neighbours are abandoned.
TEST_WIDTH = 2.1


@dataclass
class Index:
    """What every task needs: bounded by MAX_LISTS and the dimension."""

    dimension: int
    largest_norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    #: Rows of the table that bound each query's k-th product from below.
    sample_ids: np.ndarray
    sample: np.ndarray

    def flat_centroids(self) -> np.ndarray:
        """The centroids without rotation and the added coordinate."""
        return (self.centroids @ self.rotation.T)[:, :-1]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rotated vectors with one more coordinate, so that the nearest is the largest product."""
        rest = np.sqrt(np.maximum(self.largest_norm**2 - (x**2).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def lifted_query(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T


def _slices(n: int, at_once: int) -> Iterator[slice]:
    return (slice(at, at + at_once) for at in range(0, n, at_once))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _centroids(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(0)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=n)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return c


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of vectors that take part: not null, finite, not all zero."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where("vec_id IS NOT NULL AND size(embedding) > 0").where(
        F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    )


def _kept_narrow(rows: DataFrame) -> DataFrame:
    """Components as double, or as float if they are: what is shuffled is half as wide, with the same values."""
    kind = "float" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    return rows.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))


def _layout(rows: DataFrame) -> str:
    return f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}"


def _fitted(rows: DataFrame, n_lists: int | None) -> tuple[Index, int] | None:
    """Index, and the number of vectors, of the most frequent dimension."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") ** 2))
    sizes = (
        rows.groupBy(F.size("embedding").alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
        .orderBy(F.desc("n"), "d")
        .first()
    )
    if sizes is None:
        return None
    d, n = sizes["d"], sizes["n"]
    sample = (
        rows.where(F.size("embedding") == d)
        .orderBy(F.xxhash64("vec_id"), "vec_id")
        .limit(FIT_ROWS)
        .toPandas()
    )
    q, r = np.linalg.qr(np.random.default_rng(1).standard_normal((d + 1, d + 1)))
    once = sample.drop_duplicates("vec_id")
    ids, known = once["vec_id"].to_numpy(), _matrix(once["embedding"])
    index = Index(d, sizes["norm"], q * np.sign(np.diag(r)), np.empty((0, d + 1)), ids, known)
    x = index.lifted(_matrix(sample["embedding"]))
    wanted = n_lists or round(math.sqrt(n) / 2)
    index.centroids = _centroids(x, max(1, min(wanted, MAX_LISTS, len(x))))
    return index, n


def _assigned(index: Index):
    flat = index.flat_centroids()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                original = _matrix(f["embedding"])
                nearest = np.concatenate(
                    [
                        np.argmin(index.distances(index.lifted(original[part])), axis=1)
                        for part in _slices(len(original), ROWS_AT_ONCE)
                    ]
                )
                f["list_id"] = nearest
                f["away"] = np.sqrt(((original - flat[nearest]) ** 2).sum(axis=1))
                f["norm"] = np.sqrt((original**2).sum(axis=1))
                yield f

    return run


def least_products(index: Index, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest product of each query over the sample: the table's is no smaller."""
    others = len(index.sample_ids) - np.isin(ids, index.sample_ids)
    out = np.full(len(q), -np.inf)
    for part in _slices(len(q), BOUND_QUERIES):
        product = q[part] @ index.sample.T
        product[ids[part, None] == index.sample_ids] = -np.inf
        if product.shape[1] >= k:
            out[part] = np.partition(product, -k, axis=1)[:, -k]
    return np.where(others >= k, out, -np.inf)


def _probed(index: Index, sizes: np.ndarray, radii: np.ndarray, norms: np.ndarray, k: int):
    """Every list of a query that may hold one of its k largest products.

    No product in a list exceeds that with its centroid by more than the query's norm times
    the list's radius, nor the product of the norms.  A query leaves with a copy of its vector
    for each list, so few rows leave at a time.
    """
    flat = index.flat_centroids()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (f.iloc[part].copy() for f in frames for part in _slices(len(f), ROWS_AT_ONCE)):
            q = _matrix(f["embedding"])
            length = np.sqrt((q**2).sum(axis=1))[:, None]
            most = np.minimum(q @ flat.T + length * radii, length * norms)
            least = least_products(index, f["vec_id"].to_numpy(), q, k)[:, None]
            slack = 1e-9 * length * index.largest_norm
            f["list_id"] = [np.flatnonzero(p) for p in (most >= least - slack) & (sizes > 0)]
            f["least"] = (least - slack)[:, 0]
            f = f.explode("list_id").dropna(subset="list_id").astype({"list_id": "int32"})
            for part in _slices(len(f), PROBED_AT_ONCE):
                yield f.iloc[part]

    return run


def adaptive_scan(
    x: np.ndarray, q: np.ndarray, k: int, width: float = TEST_WIDTH, block: int = COLUMN_BLOCK
) -> np.ndarray:
    """Rows of `x` (rotated) that may be among the k nearest to `q`."""
    d = x.shape[1]
    if len(x) <= k:
        return np.arange(len(x))
    partial = ((x[:, :block] - q[:block]) ** 2).sum(axis=1)
    first = np.argpartition(partial, k - 1)[:k]
    bound = ((x[first] - q) ** 2).sum(axis=1).max()
    alive = np.arange(len(x))
    for at in range(block, d + block, block):
        seen = min(at, d)
        slack = (1 + width / math.sqrt(seen)) ** 2 if seen < d else 1 + 1e-9
        keep = partial * (d / seen) <= bound * slack
        alive, partial = alive[keep], partial[keep]
        if seen == d:
            break
        upto = min(at + block, d)
        partial = partial + ((x[alive, at:upto] - q[at:upto]) ** 2).sum(axis=1)
    return alive


def adaptive_pairs(
    x: np.ndarray, q: np.ndarray, within: np.ndarray, width: float = TEST_WIDTH, block: int = COLUMN_BLOCK
) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows): the same for many queries at once, each with a known distance.

    A block of columns is one matrix product while many pairs are alive; after that it is added
    up for the pairs that still are.
    """
    d = x.shape[1]

    def reach(seen: int) -> np.ndarray:
        slack = (1 + width / math.sqrt(seen)) ** 2 if seen < d else 1 + 1e-9
        return within * slack * (seen / d)

    partial, alive, seen = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool), 0
    while seen < d and np.count_nonzero(alive) > SPARSE * alive.size:
        upto = min(seen + block, d)
        own, theirs = q[:, seen:upto], x[:, seen:upto]
        partial -= 2 * own @ theirs.T
        partial += (own**2).sum(axis=1)[:, None]
        partial += (theirs**2).sum(axis=1)
        seen = upto
        alive &= partial <= reach(seen)[:, None]
    i, j = np.nonzero(alive)
    partial = partial[i, j]
    while seen < d:
        upto = min(seen + block, d)
        partial = partial + ((x[j, seen:upto] - q[i, seen:upto]) ** 2).sum(axis=1)
        keep = partial <= reach(upto)[i]
        i, j, partial, seen = i[keep], j[keep], partial[keep], upto
    return i, j


def _best_of_each(group: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner product of row i of `a` and row j of `b` for each pair."""
    at_once = max(1, COMPONENTS_AT_ONCE // a.shape[1])
    scores = [(a[i[part]] * b[j[part]]).sum(axis=1) for part in _slices(len(i), at_once)]
    return np.concatenate(scores) if scores else np.empty(0)


def _scanned(index: Index, k: int):
    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(queries) and len(vectors):
            vectors = vectors.drop_duplicates("vec_id")
            ids, original = vectors["vec_id"].to_numpy(), _matrix(vectors["embedding"])
            x = index.lifted(original)
            # All pairs of some queries and the vectors are held at once, not those of all queries.
            for part in _slices(len(queries), ROWS_AT_ONCE):
                asked = queries.iloc[part]
                found.append(_found(index, k, asked, ids, original, x))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def _found(index: Index, k: int, queries: pd.DataFrame, ids: np.ndarray, original: np.ndarray, x: np.ndarray):
    """(query ids, ids, products) of the k best of each query; `x` are the `original` vectors lifted."""
    qs = _matrix(queries["embedding"])
    # All lifted vectors have the same length, so a least product is a largest distance.
    within = (qs**2).sum(axis=1) + index.largest_norm**2 - 2 * queries["least"].to_numpy()
    lifted = index.lifted_query(qs)
    query_ids = queries["vec_id"].to_numpy()
    bounded = np.flatnonzero(within < math.inf)
    i, j = adaptive_pairs(x, lifted[bounded], within[bounded])
    pairs = [(bounded[i], j)]
    for at in np.flatnonzero(within == math.inf):
        # One more than k: the query's own row may be in the list.
        found = adaptive_scan(x, lifted[at], k + 1)
        pairs.append((np.full(len(found), at), found))
    i, j = (np.concatenate(c) for c in zip(*pairs))
    other = query_ids[i] != ids[j]
    i, j = i[other], j[other]
    score = _products(original, j, qs, i)
    best = _best_of_each(i, ids[j], score, k)
    return query_ids[i[best]], ids[j[best]], score[best]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    n_lists: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query.

    Both inputs have an id and a vector; a query never finds its own id.  Vectors that are
    null, all zero, hold a null or non-finite component, have no id, or another dimension than
    most vectors, take no part on either side.  Rows that repeat an id should repeat its
    vector and count once.  Ties go to the smaller id.  Fewer than k candidates are all
    returned; empty input gives no rows; other columns are ignored.

    No list is left out that may hold one of the k; only the hypothesis test may lose one.
    The centroids are fitted on FIT_ROWS rows; every row is indexed.  A list larger than
    SEGMENT is split over groups, as are the queries, so a list that holds a third of all
    rows is scanned by many tasks, and a list that all queries probe takes no more memory.
    """
    rows, asked = (_kept_narrow(usable(t, id_col, vector_col)) for t in (vectors, queries))
    fitted = _fitted(rows, n_lists)
    spark = vectors.sparkSession
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, _ = fitted
    same = F.size("embedding") == index.dimension
    listed = written(
        rows.where(same).mapInPandas(
            _assigned(index), _layout(rows) + ", list_id int, away double, norm double"
        ),
        "vector-lists",
    )
    n = len(index.centroids)
    sizes, radii, norms = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    extent = listed.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("away").alias("away"), F.max("norm").alias("norm")
    )
    for r in extent.collect():  # at most MAX_LISTS rows
        sizes[r["list_id"]], radii[r["list_id"]], norms[r["list_id"]] = r["n"], r["away"], r["norm"]
    listed = listed.drop("away", "norm")
    asked = asked.where(same)
    probed = asked.mapInPandas(
        _probed(index, sizes, radii, norms, k), _layout(asked) + ", list_id int, least double"
    )
    parts = F.lit(np.maximum(1, -(-sizes // SEGMENT)).tolist())
    # Any list may be probed by all queries, however few vectors it holds.
    blocks = max(1, -(-asked.count() // QUERY_SEGMENT))
    pick = lambda table: F.element_at(table, F.col("list_id") + 1).cast("int")
    left = probed.select(
        "*",
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), pick(parts) - 1)).alias("part"),
    )
    right = listed.select(
        "*",
        F.pmod(F.xxhash64("vec_id"), pick(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    by = ["list_id", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        _scanned(index, k), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
