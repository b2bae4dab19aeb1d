"""Quality of documents from their own text and, hierarchically, from their site.

A logistic classifier on text features, trained on labelled documents, gives each document a
probability.  Sums over hosts and over paths within hosts give posteriors: a host is shrunk
toward the global mean, a path toward its host, each with a strength that the variance
between groups determines (empirical Bayes).  The site's odds against the global odds then
adjust the document's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.common import slices, word_hashes, written

#: Labelled documents that the classifier is fitted on, in the order of a hash of the id.
FIT_ROWS = 20_000
FEATURES = (
    "log_words", "word_length", "symbols", "marks_per_word", "bars_per_word", "shouts_per_word",
    "capitals", "digits", "distinct_words", "repeated_next", "top_word", "lines_per_word",
    "distinct_lines",
)
_KINDS = np.zeros(256, np.int64)
for _kind, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"!",
     b"#$%&*@^~=+<>\\/[]{}_", b"\n", b" \t\r\x0b\x0c"), 1
):
    _KINDS[list(_bytes)] = _kind


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES per text; all shares are 0 for a text without words."""
    out = np.zeros((len(texts), len(FEATURES)))
    words, counts = word_hashes(texts)
    for i, (text, own) in enumerate(zip(texts, np.split(words, np.cumsum(counts)[:-1]))):
        n = len(own)
        if not n:
            continue
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = np.zeros(9, np.int64)
        for at in range(0, len(data), 1 << 20):
            kinds += np.bincount(_KINDS[data[at : at + (1 << 20)]], minlength=9)
        other, lower, upper, digits, bars, shouts, marks, newlines, spaces = kinds.tolist()
        _, repeats = np.unique(own, return_counts=True)
        lines = [line for line in text.split("\n") if line.strip()]
        letters = max(1, lower + upper)
        written_bytes = len(data) - newlines - spaces
        out[i] = (
            np.log1p(n), written_bytes / n, (marks + bars + shouts) / written_bytes, marks / n,
            bars / n, shouts / n, upper / letters, digits / written_bytes, len(repeats) / n,
            (own[1:] == own[:-1]).sum() / n, repeats.max() / n, newlines / n,
            len(set(lines)) / max(1, len(lines)),
        )
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        values = [row for a, b in slices(texts) for row in features(texts[a:b])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("host"), batch.column("path"),
             pa.array(values, pa.list_(pa.float64()))],
            ["doc_id", "host", "path", "features"],
        )


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps on standardised features; the last weight is the intercept.

    Squares of the features are included, because both extremes of some are bad.
    """
    x = _expanded(x)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    # Fold the standardisation in, so that weights apply to raw features.
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum())


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, x**2])


def _probability(weights: np.ndarray) -> Column:
    """The classifier as a column expression over the features array."""
    n = len(FEATURES)
    z = F.lit(float(weights[-1]))
    for i in range(n):
        f = F.col("features")[i]
        z = z + f * float(weights[i]) + f * f * float(weights[n + i])
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame, centre: str) -> float:
    """Prior strength from (n, s, ss, centre) per group: m(1-m) / variance between groups - 1."""
    mean = F.col("s") / F.col("n")
    r = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n") * 1.0).alias("n2"),
        F.sum("s").alias("s"),
        F.sum(F.col("n") * (mean - F.col(centre)) ** 2).alias("between"),
        F.sum(F.col("ss") - F.col("s") * mean).alias("within"),
    ).first()
    if not r["n"] or r["groups"] < 2:
        return 1e6
    m = r["s"] / r["n"]
    noise = r["within"] / max(1, r["n"] - r["groups"])
    spread = (r["between"] - (r["groups"] - 1) * noise) / max(1e-9, r["n"] - r["n2"] / r["n"])
    return float(np.clip(m * (1 - m) / max(spread, 1e-9) - 1, 1.0, 1e6))


def site_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: str | Column = "source",
    path: str | Column = "lang",
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per input row: doc_id, host, p_document, p_host, p_path, p_quality, kept.

    `labels` has the id and a 0/1 label; several labels of one document are averaged, null
    labels are ignored.  `path` is a level below `host`.  kept is p_quality >= threshold.

    Null text counts as empty and gets the classifier's value for no words.  A null host has no
    site: p_host and p_path are then the global mean.  A null path is a path of its own.  Sites
    see each document once per row; a document's own share is left out of its path's sum.
    Without labels of both classes the classifier answers 0.5 and everything is kept at the
    default threshold.  Other columns are ignored; empty input gives no rows.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        as_column(host).cast("string").alias("host"),
        as_column(path).cast("string").alias("path"),
    )
    measured = written(
        rows.mapInArrow(
            _feature_rows, "doc_id long, host string, path string, features array<double>"
        ),
        "quality-features",
    )
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("y"))
        .where("doc_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
    )
    sample = (
        measured.join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
        .select("features", "y")
        .toPandas()
    )
    y = (sample["y"].to_numpy() >= 0.5).astype(float) if len(sample) else np.empty(0)
    if len(set(y.tolist())) == 2:
        weights = fitted(np.stack(sample["features"].to_numpy()), y)
    else:
        weights = np.zeros(2 * len(FEATURES) + 1)
    scored = measured.select("doc_id", "host", "path", _probability(weights).alias("p"))
    sums = [
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") ** 2).alias("ss"),
    ]
    paths = written(
        scored.where("host IS NOT NULL")
        .groupBy("host", F.coalesce("path", F.lit("")).alias("path"))
        .agg(*sums),
        "quality-sites",
    )
    totals = scored.agg(F.avg("p").alias("m")).first()
    m = totals["m"] if totals["m"] is not None else 0.5
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    k_host = _strength(hosts.withColumn("m", F.lit(m)), "m")
    hosts = hosts.select("host", ((F.col("s") + k_host * m) / (F.col("n") + k_host)).alias("p_host"))
    sited = paths.join(hosts, "host")
    k_path = _strength(sited, "p_host")
    joined = scored.withColumn("level", F.coalesce("path", F.lit(""))).join(
        sited.select("host", F.col("path").alias("level"), "n", "s", "p_host"),
        ["host", "level"], "left",
    )
    p_host = F.coalesce("p_host", F.lit(m))
    rest = (F.col("s") - F.col("p") + k_path * p_host) / (F.col("n") - 1 + k_path)
    p_path = F.coalesce(rest, F.lit(m))
    odds = lambda p: p / (1 - p)
    global_odds = m / (1 - m) if m < 1 else 1e12
    adjusted = odds(F.col("p")) * odds(p_path) / global_odds
    return joined.select(
        "doc_id",
        "host",
        F.col("p").alias("p_document"),
        p_host.alias("p_host"),
        p_path.alias("p_path"),
        (adjusted / (1 + adjusted)).alias("p_quality"),
    ).withColumn("kept", F.col("p_quality") >= threshold)
