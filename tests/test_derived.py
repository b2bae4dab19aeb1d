import random
from itertools import combinations

import pytest

from factloom.operators.derived import derived_columns


def brute_force(rows, names):
    """The rule spelled out over rows that are already in order (first field: position)."""
    found = []
    for t in range(len(names)):
        others = [i for i in range(len(names)) if i != t]
        for a, b in combinations(others, 2):
            complete = [r[1:] for r in rows if None not in (r[1 + t], r[1 + a], r[1 + b])][:20]
            if complete and all(r[a] in r[t] and r[b] in r[t] for r in complete):
                found.append(names[t])
                break
    return found


@pytest.mark.parametrize("seed, size, gap", [(1, 60, 0.1), (2, 300, 0.6), (3, 2500, 0.997), (4, 15, 0.3)])
def test_equal_to_brute_force(spark, seed, size, gap):
    rng = random.Random(seed)
    names = ["a", "b", "joined", "noise", "sparse"]
    rows = []
    for i in range(size):
        a, b = rng.choice("xyz"), rng.choice("pq")
        row = [i, a, b, f"{a}/{b}", rng.choice(["x", "xp", "zz"]), f"{b}{a}" if i < 2000 else "other"]
        rows.append(tuple(row[:1] + [v if rng.random() > gap or k < 2 else None for k, v in enumerate(row[1:])]))
    df = spark.createDataFrame(rows, "pos int, " + ", ".join(f"{n} string" for n in names))
    expected = brute_force(rows, names)
    for parts in (1, 7):
        assert derived_columns(df.repartition(parts), ["pos"]) == expected


def test_rows_without_complete_sample_never_match(spark):
    df = spark.createDataFrame([(1, "a", None, "ab"), (2, None, "b", "ab")], "pos int, x string, y string, z string")
    assert derived_columns(df, ["pos"]) == []


def test_whole_table_mode_looks_beyond_the_sample(spark):
    rows = [(i, "a", "b", "ab" if i < 25 else "zz") for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, x string, y string, z string")
    assert derived_columns(df, ["pos"]) == ["z"]
    assert derived_columns(df, ["pos"], whole_table=True) == []
    assert derived_columns(df.where("pos < 25"), ["pos"], whole_table=True) == ["z"]


def test_files_are_taken_by_path(spark, tmp_path):
    """The larger second file is scanned first; the rows of the first file decide."""
    names = "pos int, x string, y string, z string"
    first = [(i, "a", "b", "ab") for i in range(20)]
    second = [(i, "a", "b", "zz") for i in range(20, 400)]
    for name, rows in (("a", first), ("b", second)):
        spark.createDataFrame(rows, names).coalesce(1).write.csv(str(tmp_path / name))
    df = spark.read.schema(names).csv([str(tmp_path / "a"), str(tmp_path / "b")])
    assert derived_columns(df) == ["z"]


def test_wide_sparse_table(spark):
    """Rows are multiplied by the triples they hold only: three of forty columns here."""
    rows = []
    for i in range(300):
        row = [None] * 40
        for k in range(3):
            row[(i * 3 + k) % 39] = "ab" if k == 2 else "ab"[k]
        rows.append((i, *row))
    df = spark.createDataFrame(rows, "pos int, " + ", ".join(f"c{i} string" for i in range(40)))
    assert derived_columns(df, ["pos"]) == [f"c{i}" for i in range(2, 39, 3)]
