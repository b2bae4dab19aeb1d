"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Characters that separate words: space and U+0009 to U+000D.  `bytes.split()` without an
#: argument splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"

#: A-Z to lower case, everything else as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder that the cluster names in spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder and read back: lineage ends there."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by `written` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, as doc_id long and text string ('' for null)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.array([b in SPACES for b in range(256)])
_ANY_SPACE = re.compile(rb"[ \t-\r]")
#: Text that is hashed at once; longer texts go on at the next white space.
_AT_ONCE = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers spread evenly (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def chained(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence one word longer."""
    return mixed(h * _BASE + word)


#: A number per byte, equal for both cases of A-Z.
_BYTES = mixed(np.frombuffer(LOWER, np.uint8).astype(np.uint64) + np.uint64(1))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, _AT_ONCE + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def _runs(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        end = at + _AT_ONCE
        if end < len(data):
            space = _ANY_SPACE.search(data, end)
            end = space.start() if space else len(data)
        yield at, data[at:end]
        at = end


def word_hashes(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of all words in order, and the words of each text.

    Words are runs without white space (space, U+0009 to U+000D), A-Z lower-cased.  A word's
    hash is a polynomial of its bytes, taken from running sums over the whole text.
    """
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(t) + 1 for t in encoded])
    hashes, places = [], []
    for at, run in _runs(b" ".join(encoded)):
        data = np.frombuffer(run, np.uint8)
        space = np.concatenate([[True], _SPACE[data], [True]])
        turns = np.diff(space.astype(np.int8))
        first, last = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
        up, down = _power_table(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
        h = (sums[last] - sums[first]) * down[first]
        hashes.append(mixed(h + (last - first).astype(np.uint64)))
        places.append(first + at)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(encoded), np.int64)
    owner = np.searchsorted(ends, np.concatenate(places), side="right")
    return np.concatenate(hashes), np.bincount(owner, minlength=len(encoded))


def slices(texts: list[str], at_most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `at_most` code points, to bound memory; at least one text."""
    first = held = 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > at_most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if texts:
        yield first, len(texts)
