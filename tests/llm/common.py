"""Plain Python counterparts that the operators are held against."""

from __future__ import annotations

import duckdb

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(sql: str) -> list[tuple]:
    return duckdb.connect().execute(sql).fetchall()


def documents(sf: str = SMALL) -> list[tuple]:
    return rows(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id")


def plain(df, *columns) -> list[tuple]:
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: tuple((v is not None, v) for v in r))


def table(spark, texts, ids=None, **extra):
    """A documents table; extra columns are constants."""
    ids = ids if ids is not None else range(len(texts))
    data = [(i, t, "en", "s0", len(t or ""), *extra.values()) for i, t in zip(ids, texts)]
    schema = DOCS + "".join(f", {name} string" for name in extra)
    return spark.createDataFrame(data, schema)


def words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    return [w for w in lowered.split(" ") if w]


def union_find(nodes, links) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(docs: list[tuple], size: int) -> dict:
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, text in docs:
        w = words(text)
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    ids = sorted(sets)
    links = [
        (a, b)
        for n, a in enumerate(ids) for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    groups = union_find(ids, links)
    return {i: (len(sets[i]), groups[i]) for i in ids}
