import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factloom.functions.columns import fact_hash, fact_key_json
from factloom.operators import cube


def fact_dict(frame):
    return {
        (r["dimension"], r["dimension_value"], r["metric"]): (r["sum"], r["mean"], r["count"])
        for r in frame.collect()
    }


def test_missing_group_and_empty_group(spark):
    df = spark.createDataFrame([("x", None), (None, 1.0), ("y", 2.0), ("y", 3.0)], "d string, m double")
    assert fact_dict(cube.facts(df, ["d"], ["m"])) == {
        ("d", "x", "m"): (0.0, None, 0),
        ("d", "y", "m"): (5.0, 2.5, 2),
        ("d", "(null)", "m"): (1.0, 1.0, 1),
    }


def test_null_text_and_null_are_one_fact(spark):
    df = spark.createDataFrame([("(null)", 1.0), (None, 5.0)], "d string, m double")
    assert fact_dict(cube.facts(df, ["d"], ["m"])) == {("d", "(null)", "m"): (6.0, 3.0, 2)}


def test_measures_without_values_are_left_out(spark):
    df = spark.createDataFrame([("x", None, 1.0)], "d string, empty double, m double")
    assert {k[2] for k in fact_dict(cube.facts(df, ["d"], ["empty", "m"]))} == {"m"}
    assert cube.facts(df, ["d"], ["empty"]).count() == 0
    assert cube.facts(df, [], ["m"]).count() == 0
    assert cube.facts(df, ["d"], []).count() == 0


def test_nonnull_variant(spark):
    df = spark.createDataFrame([("x", None), (None, 1.0), ("y", 2.0)], "d string, m double")
    assert fact_dict(cube.nonnull_facts(df, ["d"], ["m"])) == {("d", "y", "m"): (2.0, 2.0, 1)}


@pytest.mark.parametrize(
    "value",
    ["plain", 'a"b', "a\\b", "tab\there", "line\nbreak", "é ü", "日本", "😀", "\x7f", "\x01", "", "a/b"],
)
def test_hash_of_the_json_key(spark, value):
    row = spark.createDataFrame([("dim", value)], "d string, v string").select(
        fact_key_json(F.col("d"), F.col("v")).alias("text"), fact_hash(F.col("d"), F.col("v")).alias("hash")
    ).first()
    expected = json.dumps({"dim": value}, sort_keys=True)
    assert row["text"] == expected
    assert row["hash"] == hashlib.sha256(expected.encode()).hexdigest()


def test_result_does_not_depend_on_partitions_and_facts_are_unique(spark):
    rows = [("hot" if i % 3 else f"v{i}", f"k{i % 5}", float(i % 17)) for i in range(600)]
    df = spark.createDataFrame(rows, "a string, b string, m double")
    results = [fact_dict(cube.facts(df.repartition(p), ["a", "b"], ["m"])) for p in (1, 4, 13)]
    assert results[0] == results[1] == results[2]
    hashed = cube.with_fact_hash(cube.facts(df, ["a", "b"], ["m"]))
    assert hashed.select("fact_id").distinct().count() == hashed.count()


def test_listing_order_and_limits(spark):
    df = spark.createDataFrame([("b", 1.0), (None, 2.0), ("a", 3.0)], "d string, m double")
    stored = cube.facts(df, ["d"], ["m"])
    values = [r["dimensions"]["d"] for r in cube.list_facts(stored).collect()]
    assert values == ["a", "b", "(null)"]
    assert cube.list_facts(stored, "other").count() == 0
    assert cube.list_facts(stored, "d", 2).count() == 2
    assert cube.list_facts(stored).first()["metrics"] == {"m_sum": 3.0, "m_mean": 3.0, "m_count": 1.0}
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            cube.list_facts(stored, None, limit)
