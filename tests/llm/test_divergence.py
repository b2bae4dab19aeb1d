import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import divergence as dv
from tests.llm.common import plain

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string"


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def brute(docs, least=3, ranks=200):
    docs = [tuple(v or "" for v in d) for d in docs]
    found, held, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, text in docs:
        found[lang].update(set(terms_of(text)))
        held[lang, source].update(terms_of(text))
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in found[lang].items() if n >= least)
        sources = sorted(s for ln, s in held if ln == lang)
        count = {s: held[lang, s] for s in sources}

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(count[s]) for s in sources}
        q = shares(sum(count.values(), Counter()))
        f = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            over = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, cut in (("pair", pairs, None), ("term", over, ranks)):
                for rank, (value, item) in enumerate(sorted(items)[:cut], 1):
                    out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


def corpus(seed, n=120, sources=6, vocabulary=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abÀéж" for b in "xyzwvutsrqpo"][:vocabulary]
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.randint(2, vocabulary)]) for _ in range(rng.randint(0, 30)))
        docs.append((rng.choice(["en", "en", "de"]), f"s{min(rng.randint(0, 2 * sources), sources)}", text.title()))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_equals_dense_tables(spark, seed):
    docs = corpus(seed)
    got = plain(dv.source_divergence(spark.createDataFrame(docs, SCHEMA)))
    assert got == brute(docs) and {"pair", "term"} == {r[2] for r in got}


def test_small_bounds_change_nothing(spark, monkeypatch):
    docs = corpus(9) + [("en", "long", "Word other-word " * 200), ("en", "long", "word" * 90)]
    for name, value in (("HELD", 20), ("AT_ONCE", 7), ("PAIRS_AT_ONCE", 3), ("SALTS", 3)):
        monkeypatch.setattr(dv, name, value)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 7)
    try:
        assert plain(dv.source_divergence(spark.createDataFrame(docs, SCHEMA).repartition(5), term_ranks=4)) == brute(docs, ranks=4)
    finally:
        spark.conf.set(batch, before)


def test_nulls_empty_groups_ties_and_clashing_columns(spark):
    docs = [
        (None, None, "a b"), ("", "", "A c"), (None, "x", "a B b"), ("", "x", None), ("fr", "only", "un deux"),
        ("fr", None, ""), ("en", "s", "one"), ("en", "t", "one"), ("en", "u", "ONE one"), ("en", "v", "12 ,;"),
        ("en", "s", "one"), ("en", "s", "one"), ("en", "é", "two"), ("en", "z", "two"), ("en", "z", "two"),
    ]
    want = brute(docs)
    assert plain(dv.source_divergence(spark.createDataFrame(docs, SCHEMA))) == want
    # A language without kept terms has pairs of value 0.
    assert [r for r in want if r[0] == "fr"] == [("fr", "", "pair", "only", 0, 1), ("fr", "only", "pair", "", 0, 1)]
    wide = SCHEMA + ", term string, n long, place int, counts string, value string"
    df = spark.createDataFrame([(*d, "t", 1, 2, "c", "v") for d in docs], wide)
    assert plain(dv.source_divergence(df)) == want
    assert plain(dv.source_divergence(spark.createDataFrame([], SCHEMA))) == []


def test_tree_pairs_nodes_with_ancestors_once():
    # abc twice, abd, ab, b: as items (place, p, p without count).
    a, b, c, d = [1, 5, 1], [2, 7, 1], [3, 9, 1], [3, 8, 1]
    rows = pa.array([a + b, a + b + d, a + b + c, b], pa.list_(pa.int64()))
    tree = dv._Tree(rows, np.array([1, 1, 2, 1]))
    pairs = sorted(
        (u.tolist()[:2], o.tolist()[:2], int(n)) for up, own, below in tree.combinations() for u, o, n in zip(up, own, below)
    )
    assert pairs == [([1, 5], [2, 7], 4), ([1, 5], [3, 8], 1), ([1, 5], [3, 9], 2), ([2, 7], [3, 8], 1), ([2, 7], [3, 9], 2)]
