import math
import shutil

import pytest
from pyspark.sql import functions as F

from factloom import CommitConflict, Workspace
from factloom.operators import cube, derived
from factloom.plans import pipeline

SCHEMA = (
    "sale_id bigint, region string, product string, label string, place string, amount double, discount double,"
    " units int, flag boolean, day date, tags array<string>"
)
KNOWLEDGE = ["column_metadata", "column_stats", "pairwise_evidence", "fact_combinations"]


def sales(spark, from_, upto, long=True):
    long_name = "a product with a name that is longer than sixty-three bytes, number {}"
    rows = []
    for i in range(from_, upto):
        region = ["East", "West", None, "(null)"][i % 4]
        product = long_name.format(i % 5) if long and i % 3 else f"p{i % 5}"
        amount = [None, float("nan"), 10.0 * (i % 7) + i / 3, math.inf if i % 50 == 9 else 1e9 + i % 40][i % 4]
        rows.append(
            (i, region, product, f"{region}-{i % 3}", f"{i % 3}" if i % 6 else None, amount, 0.05 * (i % 3) + 0.011 * (i % 4) + 0.0007 * (i % 5),
             None if i % 11 == 0 else i % 13, i % 2 == 0, None, ["x"])
        )
    return spark.createDataFrame(rows, SCHEMA)


def rounded(value):
    if isinstance(value, float):
        # Small p-values magnify the last digits of what they are made of.
        return "nan" if math.isnan(value) else float(f"{value:.6g}")
    if hasattr(value, "asDict"):
        return tuple(map(rounded, value))
    return tuple(map(rounded, value)) if isinstance(value, list) else value


def content(space, dataset_id):
    at = space.snapshot(dataset_id)
    rows = {t: [rounded(r) for r in at.read(t).drop("dataset_id", "relationship_id").collect()] for t in KNOWLEDGE}
    return {t: sorted(r, key=str) for t, r in rows.items()}


def rebuilt(space, dataset_id):
    """What a build over all rows at once says."""
    space.process(dataset_id)
    return content(space, dataset_id)


@pytest.fixture
def space(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "space"))


def test_appends_equal_a_rebuild(spark, space):
    space.add(sales(spark, 0, 130), "sales", "one")
    space.process("one")
    first = content(space, "one")
    for from_, upto in ((130, 131), (131, 260), (260, 300)):
        assert space.append("one", sales(spark, from_, upto))
    appended = content(space, "one")
    assert appended != first and space.rows("one").count() == 300
    registry = space.datasets().first()
    assert (registry["status"], registry["row_count"], registry["column_count"]) == ("processed", 300, 11)
    assert rebuilt(space, "one") == appended
    stats = {r["name"]: r for r in space.schema("one").collect()}
    assert any("longer than sixty-three" in v for v in stats["product"]["distribution"]["labels"])


def test_only_new_rows_are_read(spark, space, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    sales(spark, 0, 130).write.parquet(old)
    sales(spark, 130, 260).write.parquet(new)
    space.register(old, dataset_id="one")
    space.process("one")
    shutil.move(old, old + "-away")  # whoever reads the old rows fails now
    assert space.append("one", new)
    shutil.move(old + "-away", old)
    appended = content(space, "one")
    assert rebuilt(space, "one") == appended


def test_the_same_path_counts_once(spark, space, tmp_path):
    space.add(sales(spark, 0, 60), "sales", "one")
    space.process("one")
    sales(spark, 60, 90).write.parquet(str(tmp_path / "new"))
    assert space.append("one", str(tmp_path / "new"))
    after = content(space, "one")
    assert not space.append("one", str(tmp_path / "new"))
    assert content(space, "one") == after and space.datasets().first()["row_count"] == 90


def test_changed_roles_group_the_earlier_rows_again(spark, space):
    # A unique column is an identifier until values repeat: then it is a measure.
    schema = "score int, kind string"
    space.add(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], schema), "scores", "one")
    space.process("one")
    assert space.store.read("fact_combinations", "one").count() == 0
    assert space.append("one", spark.createDataFrame([(5, "a"), (50, "c")], schema))
    facts = {r["dimension_value"]: r["sum"] for r in space.store.read("fact_combinations", "one").collect()}
    assert facts == {"a": sum(range(0, 30, 2)) + 5.0, "b": float(sum(range(1, 30, 2))), "c": 50.0}
    appended = content(space, "one")
    # And one that stops being a category stays out of the facts.
    assert rebuilt(space, "one") == appended


def test_columns_must_be_the_same(spark, space):
    space.add(sales(spark, 0, 60), "sales", "one")
    space.process("one")
    before = content(space, "one")
    for other in (sales(spark, 60, 70).drop("units"), sales(spark, 60, 70).withColumn("units", F.col("units").cast("string"))):
        with pytest.raises(ValueError, match="other columns"):
            space.append("one", other)
    assert content(space, "one") == before and space.datasets().first()["status"] == "processed"


def test_of_two_appends_to_one_state_one_is_refused(spark, space, monkeypatch):
    space.add(sales(spark, 0, 60), "sales", "one")
    space.process("one")
    real, other = pipeline._extend, Workspace(spark, space.store.root)

    def overtaken(*given):
        monkeypatch.setattr(pipeline, "_extend", real)
        other.append("one", sales(spark, 60, 70))
        return real(*given)

    monkeypatch.setattr(pipeline, "_extend", overtaken)
    with pytest.raises(CommitConflict):
        space.append("one", sales(spark, 70, 80))
    assert space.datasets().first()["row_count"] == 70 and space.rows("one").count() == 70


def test_text_files_are_appended_in_order(spark, space, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_text("city,part,price\n" + "".join(f"{c},{p},{v}\n" for c, p, v in rows))
        return str(tmp_path / name)

    first = write("b.csv", [("Ab-x", "Ab", 1.5), ("Cd-x", "Cd", 2.5)] * 4)
    second = write("a.csv", [("Ab-x", "Ab", 3.25), ("Ef-x", "Ef", 0.5)] * 4)
    space.process(space.register(first, "csv", dataset_id="shop"))
    assert space.append("shop", second, "csv")
    appended = content(space, "shop")
    assert rebuilt(space, "shop") == appended and space.rows("shop").count() == 16
    assert space.rows("shop").columns == ["city", "part", "price"]


@pytest.mark.parametrize("cuts", [(7,), (3, 9), (1, 2, 30)])
def test_derived_columns_go_on_with_later_rows(spark, cuts):
    rows = [
        (i, f"{'xy'[i % 2]}-{'ab'[i % 2]}" if i % 3 else None, "xy"[i % 2], "ab"[i % 2], "q" if i == 33 else None,
         "x" if i < 25 else "?")
        for i in range(60)
    ]
    schema = "i int, both string, one string, two string, rare string, early string"
    whole = spark.createDataFrame(rows, schema)
    want = derived.derived_columns(whole, ["i"])
    edges = [0, *cuts, 60]
    parts = [whole.where(F.col("i").between(a, b - 1)) for a, b in zip(edges, edges[1:])]
    state = derived.derived_state(parts[0], ["i"])
    for part in parts[1:]:
        state = derived.with_later_rows(state, part, ["i"])
    assert state.names(derived.text_names(whole)) == want and "both" in want


def test_merged_cubes_keep_digits(spark):
    schema = "d string, m double"
    rows = [(["a", "b", None][i % 3], 1e9 + (i % 5) / 8) for i in range(90)] + [("c", 4.0), ("e", None)]
    whole = spark.createDataFrame(rows, schema)
    first, second = spark.createDataFrame(rows[:31], schema), spark.createDataFrame(rows[31:], schema)
    merged = cube.merged_cubes(cube.cube(first, ["d"], ["m"]), cube.cube(second, ["d"], ["m"])).collect()
    want = {r["value"]: r for r in cube.cube(whole, ["d"], ["m"]).collect()}
    assert len(merged) == len(want) == 5
    for r in merged:
        assert r["count"] == want[r["value"]]["count"]
        for c in ("sum", "mean", "variance"):
            assert r[c] == (None if want[r["value"]][c] is None else pytest.approx(want[r["value"]][c], rel=1e-5))
