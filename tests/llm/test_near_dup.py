import random

import numpy as np
import pyarrow as pa

from factloom.llm import near_dup
from factloom.llm.near_dup import band_keys, near_duplicates, shingles, signature
from tests.llm.common import SMALL, documents, near_groups, plain, table


def check(spark, docs, size):
    found = near_duplicates(table(spark, [t for _, t in docs], [i for i, _ in docs], bucket="b"), size=size)
    want = sorted((i, n, c, i == c) for i, (n, c) in near_groups(docs, size).items())
    assert plain(found) == want


def test_against_all_pairs(spark):
    check(spark, documents(SMALL), 2)


def test_edited_copies(spark):
    """Groups of copies with more and more edits, around the limit, long and very short ones."""
    rng = random.Random(5)
    texts = []
    for length in (1, 2, 3, 5, 6, 9, 12, 40, 120, 400):
        base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, length // 8))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    texts += [None, "", " \n ", "A b", "a B", "one"]
    docs = list(enumerate(texts))
    check(spark, docs, 2)


def test_repeated_and_missing_ids(spark):
    found = near_duplicates(table(spark, ["a b c", "a b c", "a b c", "z y"], [4, 4, None, None]))
    assert plain(found, "doc_id", "component_id", "kept") == [
        (None, None, True), (None, 4, False), (4, 4, True), (4, 4, True),
    ]
    assert near_duplicates(table(spark, [])).collect() == []


def test_bins_agree_like_sets():
    rng = np.random.default_rng(0)
    for n in (5, 50, 2000):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, n + n // 4 + 1, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[:n]), np.unique(pool[n // 5 :][:n])
            similarity = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            agree.append((signature(a) == signature(b)).mean() - similarity)
        assert abs(np.mean(agree)) < 0.05
    assert len(band_keys(signature(np.array([7], np.uint64)))) == 64
    assert len(shingles(np.array([3, 4], np.uint64), 5)) == 1


def test_many_near_copies_and_texts_that_share_a_passage(spark, monkeypatch):
    """Large buckets: a chain of copies, and texts that share most words without being similar enough."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, texts = new(60), []
    for i in range(150):  # drifts away, a word at a time
        base[rng.randrange(60)] = f"d{i}"
        texts.append(list(base))
    passage = new(40)
    texts += [passage + new(8 + i % 9) for i in range(60)]
    near = new(80)
    texts += [[*near[:i], f"n{i}", *near[i + 1 :]] for i in range(80)]
    rng.shuffle(texts)
    check(spark, list(enumerate(map(" ".join, texts))), 2)


def test_sketches_drop_no_similar_pair(spark):
    rng = np.random.default_rng(1)
    rows = []
    for n in (1, 3, 9, 30, 100, 400, 3000):
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, n + n // 4 + 1, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(pool[: n + n // 4]), np.unique(pool[: max(1, n)])  # b in a: similarity 0.8 and more
            other = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for right, similar in ((b, True), (other, False)):
                words = [near_dup.bit_sketch(signature(s)).tolist() for s in (a, right)]
                rows.append((n, similar, len(a), len(right), *words[0], *words[1]))
    columns = ["size", "similar", "n", "centre_n", *(f"k{i}" for i in range(8)), *(f"c{i}" for i in range(8))]
    kept = spark.createDataFrame(rows, columns).where(near_dup._may_be_similar(80)).groupBy("size", "similar").count()
    counts = {(r["size"], r["similar"]): r["count"] for r in kept.collect()}
    assert all(counts[n, True] == 40 for n in (1, 3, 9, 30, 100, 400, 3000))
    assert not any(counts.get((n, False)) for n in (400, 3000))


def test_texts_that_share_a_passage_do_not_meet_pair_by_pair(spark, monkeypatch):
    """Similarity 0.6 to 0.75 by one passage: the pairs that are compared in full stay few."""
    met, links = [], near_dup._links

    def counted(sets, pairs, percent):
        met.append(pairs.count())
        return links(sets, pairs, percent)

    monkeypatch.setattr(near_dup, "_links", counted)
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = new(40)
    check(spark, [(i, " ".join(passage + new(8 + i % 5))) for i in range(120)], 2)
    # The first two are stars; of 7,140 pairs nearly all share a band.
    assert sum(met[2:]) < 120


def test_rarest_shingles_of_similar_sets_meet():
    """Sets at the limit have one of their first shingles in common, at a place that lets them meet."""
    rng = np.random.default_rng(2)
    for n in (1, 4, 5, 9, 45, 200):
        pool = np.unique(rng.integers(-(1 << 62), 1 << 62, 2 * n + 2))
        seen = rng.integers(0, 3, len(pool)) * 5
        common = -(-80 * 2 * n // 180)
        own = n - common
        for left, right in ((pool[:n], pool[own : own + n]), (pool[:n], pool[: -(-80 * n // 100)])):
            slots = pa.array([0, 0], pa.int64())
            batch = pa.RecordBatch.from_arrays(
                [slots, pa.array([left, right], pa.list_(pa.int64())), slots], ["id", "hashes", "slot"]
            )
            run = near_dup._rarest_first(b"\1", pool, seen, 80)
            a, b = next(run([batch])).column("shingles").to_pylist()
            first = sorted(set(left) & set(right), key=lambda s: (seen[np.searchsorted(pool, s)], s))[0]
            need = -(-80 * (len(left) + len(right)) // 180)
            assert a.index(first) + need <= len(left) and b.index(first) + need <= len(right)
