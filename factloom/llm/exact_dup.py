"""Exact deduplication over content-defined chunk recipes.

A normalised text is cut where a rolling hash of its last 32 bytes says so; equal passages
of different documents fall into equal chunks.  Each distinct chunk is moved once to verify
that its 128-bit key names one byte string only; a document is then represented by the
ordered list of its chunk identifiers, and only these short lists are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import SPACES, id_and_text, written

MIN_CHUNK, MAX_CHUNK = 256, 16_384
#: On average one byte in 1,024 ends a chunk.
CUT_MASK = np.uint32(0x3FF << 22)
WINDOW = 32
_SEGMENT = 1 << 20

_GEAR = np.frombuffer(
    b"".join(xxhash.xxh32_digest(bytes([i])) for i in range(256)), dtype=">u4"
).astype(np.uint32)


def _cut_points(data: bytes) -> np.ndarray:
    """Ends of chunks that the content proposes; they depend on the 32 bytes before only."""
    found = []
    for start in range(0, len(data), _SEGMENT):
        lead = max(0, start - WINDOW)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), start + _SEGMENT) - lead, lead)]
        for step in (1, 2, 4, 8, 16):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        ends = np.flatnonzero((h & CUT_MASK) == 0) + lead + 1
        found.append(ends[ends > start])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunks_of(data: bytes) -> list[bytes]:
    """Content-defined chunks in order; their concatenation is the input."""
    if len(data) <= MIN_CHUNK:
        return [data]
    ends, last = [], 0
    for cut in [*_cut_points(data).tolist(), len(data)]:
        while cut - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if cut - last >= MIN_CHUNK or cut == len(data) > last:
            ends.append(last := cut)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACES)


def _recipes(key: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            length, digest, recipe = [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                data = _normalised(text)
                length.append(len(text))
                digest.append(hashlib.sha256(data).hexdigest())
                recipe.append([key(c) for c in chunks_of(data)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length, pa.int64()), pa.array(digest),
                 pa.array(recipe, pa.list_(pa.binary()))],
                ["doc_id", "n_points", "text_sha256", "recipe"],
            )

    return run


def _chunk_rows(key: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            seen: set[tuple[bytes, bytes]] = set()
            for i in range(batch.num_rows):
                seen.update((key(c), c) for c in chunks_of(_normalised(texts[i].as_py())))
            pairs = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in pairs], pa.binary()),
                 pa.array([c for _, c in pairs], pa.binary())],
                ["key", "chunk"],
            )

    return run


def _place_rows(key: Callable[[bytes], bytes]):
    """Every chunk with its place; only run when keys collide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                data = _normalised(texts[i].as_py())
                chunks = chunks_of(data)
                digest = hashlib.sha256(data).hexdigest()
                n = len(chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i].as_py()] * n, pa.int64()), pa.array([digest] * n),
                     pa.array(range(n), pa.int32()),
                     pa.array([key(c) for c in chunks], pa.binary()), pa.array(chunks, pa.binary())],
                    ["doc_id", "text_sha256", "place", "key", "chunk"],
                )

    return run


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_key: Callable[[bytes], bytes] = _key,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space (space, U+0009 to U+000D).  Of equal
    texts the one with the most code points stays, then the smallest doc_id.

    Null text counts as empty, and empty texts equal each other.  A null doc_id stays only if
    its group has no other; keep_id is then null.  Rows that repeat a doc_id with the same
    text count in group_size and all carry kept = true when that doc_id stays.  Other columns
    of the input are not looked at.  Empty input gives no rows.

    Two texts meet as lists of 16-byte identifiers.  `chunk_key` names a chunk; if it gives
    different chunks one key, their rank among the chunks of that key is added to the list.
    """
    rows = id_and_text(docs, id_col, text_col)
    distinct = rows.mapInArrow(_chunk_rows(chunk_key), "key binary, chunk binary").distinct()
    shared = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = written(shared, "chunk-keys")
    recipes = rows.mapInArrow(
        _recipes(chunk_key),
        "doc_id long, n_points long, text_sha256 string, recipe array<binary>",
    )
    if shared.isEmpty():
        by = ["recipe"]
    else:
        recipes, by = _with_ranks(rows, distinct, shared, recipes, chunk_key), ["recipe", "ranks"]
    kept = recipes.groupBy(*by).agg(
        F.max(
            F.struct(
                "n_points",
                F.col("doc_id").isNotNull().alias("named"),
                F.bitwise_not("doc_id").alias("reversed_id"),
            )
        ).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    ).select(*by, "group_size", F.bitwise_not("best.reversed_id").alias("keep_id"))
    return recipes.join(kept, by).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _with_ranks(rows, distinct, shared, recipes, chunk_key) -> DataFrame:
    """Recipes with (place, rank) of every chunk whose key several byte strings share."""
    ranked = distinct.join(shared, "key").withColumn(
        "rank", F.rank().over(Window.partitionBy("key").orderBy("chunk"))
    )
    places = (
        rows.mapInArrow(
            _place_rows(chunk_key),
            "doc_id long, text_sha256 string, place int, key binary, chunk binary",
        )
        .distinct()
        .join(ranked, ["key", "chunk"])
    )
    lists = places.groupBy(F.col("doc_id").alias("d"), F.col("text_sha256").alias("t")).agg(
        F.sort_array(F.collect_list(F.struct("place", "rank"))).alias("ranks")
    )
    return (
        recipes.join(
            lists,
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_sha256") == F.col("t")),
            "left",
        )
        .drop("d", "t")
        .withColumn("ranks", F.coalesce("ranks", F.array().cast("array<struct<place:int,rank:int>>")))
    )
