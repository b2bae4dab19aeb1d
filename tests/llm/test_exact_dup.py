import hashlib
import random

import pytest

from factloom.llm.exact_dup import MAX_CHUNK, chunks_of, exact_duplicates
from tests.llm.common import plain, table

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def expected(docs):
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in docs:
        groups.setdefault(strip(t), []).append((len(t or ""), i))
    out = []
    for i, t in docs:
        own = groups[strip(t)]
        named = [(-n, j) for n, j in own if j is not None]
        longest = max(n for n, _ in own)
        keep = min((j for n, j in own if n == longest and j is not None), default=None)
        if keep is None and named:
            keep = None
        out.append((i, keep, len(own), i == keep, hashlib.sha256(strip(t).encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def test_chunks_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 123) for _ in range(300_000))
    chunks = chunks_of(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= MAX_CHUNK
    moved = chunks_of(b"something put in front" + data)
    assert len(set(chunks) & set(moved)) > 0.95 * len(set(chunks))
    assert b"".join(chunks_of(b"x" * 100_000)) == b"x" * 100_000
    assert chunks_of(b"") == [b""]


def test_edge_cases(spark):
    long = "word " * 40_000
    texts = ["a b", "ab", "a  b", None, "", " \n", "é", "é", "\u00a0", "ab", long, long + " ", "A b"]
    docs = list(zip([5, 3, 9, 7, 6, 8, 2, 1, 4, 3, 20, 21, 22], texts))
    found = exact_duplicates(table(spark, texts, [i for i, _ in docs], key="k", recipe="r"))
    assert found.columns == COLUMNS
    assert plain(found) == expected(docs)


def test_missing_ids(spark):
    found = exact_duplicates(table(spark, ["a", "a", "b", "b"], [None, 4, None, None]))
    assert plain(found, "doc_id", "keep_id", "kept") == [
        (None, None, True), (None, None, True), (None, 4, False), (4, 4, True),
    ]


def test_empty_table(spark):
    assert exact_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("width", [0, 1])
def test_colliding_chunk_keys(spark, width):
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdef ") for _ in range(700)) for _ in range(6)]
    texts = ["".join(rng.choice(pool) for _ in range(3)) for _ in range(60)] + ["", None, "x"]
    docs = list(zip(range(len(texts)), texts))
    weak = exact_duplicates(table(spark, texts), chunk_key=lambda c: c[:width])
    assert plain(weak) == expected(docs)
