"""Hard negatives from Kronecker-packed integer products.

Vectors become integers, floor(scale * x).  The components of several candidates are biased to
be non-negative and laid side by side in separated fields of one wide integer; multiplying that
by one anchor component multiplies all of them, and the sum over the components holds one exact
inner product per field.  The wide integer is the 53-bit mantissa of a double, so that the sums
run as a matrix product; the field is as wide as the largest possible sum.

Anchors are a stated query set: every block of anchors meets every block of rows.  A first pass
finds each anchor's positives, a second one the negatives in the score band of each positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.common import written

#: Components that a block of rows, and a block of anchors, holds on average.
ROW_COMPONENTS, ANCHOR_COMPONENTS = 1 << 19, 1 << 21
#: Scores worked on at a time.
TILE = 1 << 21
#: Bits of an integer that a double adds up exactly.
MANTISSA = 53
#: Larger integer components are refused: their products might not fit in 64 bits.
MOST = 1 << 21

_PAIR = "anchor_id long, vec_id long, score long"
_BAND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of integer vectors."""
    n, d = rows.shape
    if not n or not d or not len(anchors):
        return np.zeros((len(anchors), n), np.int64)
    a0, r0 = int(anchors.min()), int(rows.min())
    a, r = anchors - a0, rows - r0
    field = max((d * int(a.max()) * int(r.max())).bit_length(), 1)
    fields = MANTISSA // field
    if not fields:  # a field wider than the mantissa: one to a 64-bit word
        return anchors @ rows.T
    words = -(-n // fields)
    packed = np.zeros((words, d))
    for f in range(fields):
        part = r[f * words : (f + 1) * words]
        packed[: len(part)] += part * float(1 << (f * field))
    sums = (a.astype(np.float64) @ packed.T).astype(np.int64)
    out = np.empty((len(a), fields * words), np.int64)
    for f in range(fields):
        out[:, f * words : (f + 1) * words] = (sums >> (f * field)) & ((1 << field) - 1)
    out = out[:, :n]
    # (a + a0)(r + r0) summed: take the biases off again.
    out += a0 * r.sum(axis=1)[None, :] + r0 * a.sum(axis=1)[:, None] + d * a0 * r0
    return out


def integer_vectors(
    vectors: DataFrame, label: Column, scale: int, id_col: str, label_col: str, vector_col: str
) -> DataFrame:
    """(vec_id, label, v): one row per id that takes part, v as integers."""
    v = F.col(vector_col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    small = lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")) <= MOST
    return (
        vectors.select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("__label"), v.alias("__v")
        )
        .where(F.col("vec_id").isNotNull() & F.col("__label").isNotNull() & F.col("__v").isNotNull())
        .where(F.forall("__v", fine))
        .where(F.forall("__v", small))
        .select(
            "vec_id",
            label.alias("label"),
            F.transform("__v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"),
        )
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "v")).alias("row"))
        .select("vec_id", "row.label", "row.v")
    )


def _blocked(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int):
    """Both sides keyed by (row_block, anchor_block), each repeated over the other's blocks."""
    dealt = F.xxhash64("vec_id")
    left = anchors.select(
        "*",
        F.pmod(dealt, F.lit(anchor_blocks)).cast("int").alias("anchor_block"),
        F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("row_block"),
    )
    right = rows.select(
        "*",
        F.pmod(dealt, F.lit(row_blocks)).cast("int").alias("row_block"),
        F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("anchor_block"),
    )
    by = ["row_block", "anchor_block"]
    return left.groupBy(*by).cogroup(right.groupBy(*by))


class _Vectors:
    """Vectors of one Arrow table by length, in the order of their ids."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        lists = table["v"].combine_chunks()
        self.lengths = np.diff(lists.offsets.to_numpy())
        self.starts = lists.offsets.to_numpy()[:-1]
        self.values = lists.values.to_numpy()

    def of_length(self, d: int, label: int | None = None) -> np.ndarray:
        """Places of the vectors of a length (and label), by rising id."""
        fits = self.lengths == d
        if label is not None:
            fits &= self.labels == label
        at = np.flatnonzero(fits)
        return at[np.argsort(self.ids[at])]

    def matrix(self, at: np.ndarray, d: int) -> np.ndarray:
        return self.values[self.starts[at][:, None] + np.arange(d)].astype(np.int64)


def _tiles(n_anchors: int, n_rows: int) -> Iterator[tuple[slice, slice]]:
    wide = min(n_rows, 8192)
    high = max(1, TILE // max(wide, 1))
    for a in range(0, n_anchors, high):
        for r in range(0, n_rows, wide):
            yield slice(a, min(a + high, n_anchors)), slice(r, min(r + wide, n_rows))


def _first_k(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k highest scores, ties to the smaller id; in that order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


def _batch(names: list[str], columns: list[list[np.ndarray]]) -> pa.Table:
    whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
    return pa.table([pa.array(c, pa.int64()) for c in whole], names=names)


def _positives(k: int):
    """Each anchor's first k rows of its label among one block of rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(anchors) and len(rows):
            a, r = _Vectors(anchors), _Vectors(rows)
            for d, label in sorted(set(zip(a.lengths.tolist(), a.labels.tolist()))):
                at, found = a.of_length(d, label), r.of_length(d, label)
                x, y = a.matrix(at, d), r.matrix(found, d)
                for up, across in _tiles(len(at), len(found)):
                    score = packed_products(x[up], y[across])
                    ids, own = r.ids[found[across]], a.ids[at[up]]
                    least = np.full(len(score), np.iinfo(np.int64).min)
                    if score.shape[1] > k + 1:  # one more: the anchor itself may be among them
                        least = np.partition(score, -(k + 1), axis=1)[:, -(k + 1)]
                    i, j = np.nonzero(score >= least[:, None])
                    other = own[i] != ids[j]
                    i, j = i[other], j[other]
                    best = _first_k(i, score[i, j], ids[j], k)
                    for column, values in zip(out, (own[i[best]], ids[j[best]], score[i[best], j[best]])):
                        column.append(values)
        return _batch(["anchor_id", "vec_id", "score"], out)

    return run


def _negatives(k: int, low: int, high: int):
    """First k rows of another label in the band of each positive, among one block of rows."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        if len(anchors) and len(rows):
            a, r = _Vectors(anchors), _Vectors(rows)
            anchors = anchors.combine_chunks()
            positive = {c: anchors[c].combine_chunks() for c in ("positive_ids", "positive_scores")}
            from_, upto = (positive["positive_ids"].offsets.to_numpy()[s] for s in (slice(-1), slice(1, None)))
            p_ids, p_scores = (p.values.to_numpy() for p in positive.values())
            for d in sorted(set(a.lengths.tolist())):
                at, found = a.of_length(d), r.of_length(d)
                x, y = a.matrix(at, d), r.matrix(found, d)
                ranks = int((upto - from_)[at].max(initial=0))
                for up, across in _tiles(len(at), len(found)):
                    mine, ids = at[up], r.ids[found[across]]
                    score = packed_products(x[up], y[across])
                    # Scores of the positives by rank; an absent one has an empty band.
                    there = from_[mine][:, None] + np.arange(ranks)
                    has = there < upto[mine][:, None]
                    goal = np.where(has, p_scores[np.where(has, there, 0)], -1)
                    least, most = -(-low * goal // 100), high * goal // 100
                    empty = least > most
                    lowest = np.where(empty, np.iinfo(np.int64).max, least).min(axis=1)
                    highest = np.where(empty, np.iinfo(np.int64).min, most).max(axis=1)
                    i, j = np.nonzero((score >= lowest[:, None]) & (score <= highest[:, None]))
                    differs = a.labels[mine][i] != r.labels[found[across]][j]
                    i, j = i[differs], j[differs]
                    s = score[i, j]
                    for rank in range(ranks):
                        inside = np.flatnonzero((s >= least[i, rank]) & (s <= most[i, rank]))
                        best = inside[_first_k(i[inside], s[inside], ids[j[inside]], k)]
                        owner = mine[i[best]]
                        place = from_[owner] + rank
                        values = (a.ids[owner], p_ids[place], p_scores[place], ids[j[best]], s[best])
                        for column, v in zip(out, values):
                            column.append(v)
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return _batch(names, out)

    return run


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    band: tuple[int, int] = (50, 95),
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is a condition on vec_id; ``label`` an expression over vec_id and __label, the
    row's own label.  Scores are inner products of the integer vectors.  An anchor's positives
    are its first ``positives`` other rows of the same label; for each, the first ``negatives``
    rows of another label whose score is between ``band`` per cent of the positive's are
    returned.  Higher scores come first, ties by smaller id; fewer are all returned.

    Rows without id, label or vector, with a null or non-finite component, or with one whose
    integer exceeds MOST take no part.  Rows that repeat an id count once: the one with the
    smallest label, then the smallest vector.  Only vectors of equal length are compared; empty
    ones score 0.  A positive with a negative score has an empty band.  Empty input gives no
    rows; other columns are ignored.

    Work is anchors times rows.  Neither side is gathered: blocks hold about ROW_COMPONENTS and
    ANCHOR_COMPONENTS components whatever the labels, so a label with most rows changes nothing.
    """
    rows = written(integer_vectors(vectors, label, scale, id_col, label_col, vector_col), "integer-vectors")
    anchors = rows.where(is_anchor)
    size = F.coalesce(F.sum(F.greatest(F.size("v"), F.lit(1))), F.lit(0))
    n_rows, n_anchors = (t.agg(size.alias("n")).first()["n"] for t in (rows, anchors))
    blocks = (n_rows // ROW_COMPONENTS + 1, n_anchors // ANCHOR_COMPONENTS + 1)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    first = (
        _blocked(rows, anchors, *blocks)
        .applyInArrow(_positives(positives), _PAIR)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= positives)
        # At most `positives` entries per anchor.
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
        .select(
            F.col("anchor_id").alias("vec_id"),
            F.col("p.vec_id").alias("positive_ids"),
            F.col("p.score").alias("positive_scores"),
        )
    )
    asked = written(anchors.join(first, "vec_id"), "anchors")
    hardest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        _blocked(rows, asked, *blocks)
        .applyInArrow(_negatives(negatives, *band), _BAND)
        .withColumn("rank", F.row_number().over(hardest))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
