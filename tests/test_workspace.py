import json

import pytest

from factloom import DatasetNotFound, DatasetNotReady, Workspace
from factloom.streaming.arrivals import watch_inbox

SCHEMA = "sale_id bigint, region string, product string, amount double, discount double"


def sample(spark, shift=0.0):
    rows = [
        (i, ["East", "West", None][i % 3], f"p{i % 4}", 10.0 * (i % 7) + shift, 0.05 * (i % 3))
        for i in range(60)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def workspace(spark, tmp_path_factory):
    space = Workspace(spark, str(tmp_path_factory.mktemp("space")))
    space.add(sample(spark), "sales", "one")
    space.process("one", ["sale_id"])
    return space


def test_registry_follows_the_life_of_a_dataset(spark, tmp_path):
    space = Workspace(spark, str(tmp_path))
    assert space.datasets().count() == 0
    space.add(sample(spark), "sales", "one")
    row = space.datasets().first()
    assert (row["status"], row["row_count"], row["name"]) == ("processing", 0, "sales")
    with pytest.raises(DatasetNotReady):
        space.evidence("one", "amount", "region")
    with pytest.raises(DatasetNotFound):
        space.schema("other")
    space.process("one")
    row = space.datasets().first()
    assert (row["status"], row["row_count"], row["column_count"]) == ("processed", 60, 5)
    assert row["created_at"] <= row["updated_at"]


def test_failure_is_recorded_and_raised(spark, tmp_path):
    space = Workspace(spark, str(tmp_path))
    space.register(str(tmp_path / "nothing.parquet"), dataset_id="gone")
    with pytest.raises(Exception):
        space.process("gone")
    assert space.datasets().first()["status"] == "error"
    with pytest.raises(ValueError):
        space.register("x", dataset_id="../escape")


def test_schema_and_reads(workspace):
    rows = workspace.schema("one").collect()
    assert [r["name"] for r in rows] == SCHEMA.replace(",", "").split()[::2]
    assert [r["business_role"] for r in rows] == ["IDENTIFIER", "DIMENSION", "DIMENSION", "MEASURE", "RATE"]
    assert workspace.relationships("one").count() == 4
    assert workspace.facts("one", "region").count() == 3
    assert workspace.group_means("one", "product", "amount").count() == 4
    assert workspace.evidence("one", "amount", "region").first()["source"] == "combination_store"


def test_reprocessing_replaces_everything_and_keeps_other_datasets(spark, workspace):
    workspace.add(sample(spark).where("region = 'East'").select("sale_id", "product", "amount"), "two", "two")
    workspace.process("two")
    workspace.add(sample(spark).select("sale_id", "region", "amount"), "two", "two")
    workspace.process("two")
    facts = workspace.store.read("fact_combinations", "two")
    assert {r[0] for r in facts.select("dimension").distinct().collect()} == {"region"}
    workspace.add(sample(spark).select("sale_id"), "two", "two")
    workspace.process("two")
    assert workspace.store.read("fact_combinations", "two").count() == 0
    assert workspace.store.read("fact_combinations", "one").count() > 0


def test_answers_are_kept_once_per_batch(spark, workspace):
    asked = spark.createDataFrame(
        [(1, "Top regions by amount and why?"), (2, "Hi"), (3, "Lowest amount for east")],
        "question_id int, query_text string",
    )
    workspace.ask("one", asked, batch="b1")
    stored = workspace.ask("one", asked, batch="b1").orderBy("question_id").collect()
    assert [r["question_id"] for r in stored] == ["1", "3"]
    assert workspace.store.read("analyst_queries", "one").count() == 2
    package = stored[1]["evidence_package"]
    assert package["filters_applied"] == {"region": "East"}
    assert stored[0]["structure"]["dimensions"] == ["region"]
    assert all(o["dimension"] == "region" for o in stored[0]["evidence_package"]["observations"])


def test_csv_dataset_end_to_end(spark, tmp_path):
    (tmp_path / "shop.csv").write_text(
        "city,price,units\n" + "\n".join(f"{'AB'[i % 2]},{i % 5}.5,{i % 3 or 'NA'}" for i in range(30)) + "\n"
    )
    space = Workspace(spark, str(tmp_path / "space"))
    space.process(space.register(str(tmp_path / "shop.csv"), "csv", dataset_id="shop"))
    roles = {r["name"]: (r["business_role"], r["unit"]) for r in space.schema("shop").collect()}
    assert roles == {"city": ("DIMENSION", None), "price": ("MEASURE", "currency"), "units": ("MEASURE", None)}


def test_arrivals_are_processed_and_failures_do_not_stop_the_stream(spark, tmp_path):
    sample(spark).write.parquet(str(tmp_path / "good"))
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    space = Workspace(spark, str(tmp_path / "space"))

    def announce(number, *lines):
        text = "\n".join(json.dumps({"dataset_id": i, "path": p, "format": "parquet", "name": i}) for i, p in lines)
        (inbox / f"{number}.json").write_text(text + "\n")
        watch_inbox(space, str(inbox), str(tmp_path / "progress")).awaitTermination()
        return {r["dataset_id"]: r["status"] for r in space.datasets().collect()}

    assert announce(1, ("bad", str(tmp_path / "none")), ("first", str(tmp_path / "good"))) == {
        "bad": "error", "first": "processed",
    }
    before = space.store.read("datasets", "first").count()
    assert announce(2, ("second", str(tmp_path / "good")))["second"] == "processed"
    # The stream goes on where it stopped.
    assert space.store.read("datasets", "first").count() == before
