import datetime
from decimal import Decimal

import pytest

from factloom.operators.catalog import (
    collect_roles, column_catalog, dimension_names, measure_names, semantic_roles,
)
from factloom.operators.derived import derived_columns


def roles_of(spark, rows, schema):
    described = semantic_roles(column_catalog(spark.createDataFrame(rows, schema)))
    return {r["name"]: r for r in described.collect()}


@pytest.mark.parametrize(
    "name, dtype, values, role, rule",
    [
        ("order-id", "double", [1.0, 1.0, 2.0], "IDENTIFIER", "identifier_name"),
        ("l_orderkey", "bigint", [5, 5, 2], "MEASURE", "measure"),
        ("anything", "double", [1.5, 2.5, None], "IDENTIFIER", "identifier_unique"),
        ("lifetime_value", "double", [9.0, 9.0, 2.0], "TIME_DIMENSION", "time"),
        ("candidate", "string", ["a", "a", "b"], "TIME_DIMENSION", "time"),
        ("seen", "date", [datetime.date(2020, 1, 1)] * 3, "TIME_DIMENSION", "time"),
        ("price_rate", "double", [0.1, 0.2, 0.2], "MEASURE", "currency"),
        ("discount", "double", [10.0, 20.0, 20.0], "RATE", "rate"),
        ("delta", "double", [-5.0, -3.0, -3.0], "RATE", "rate"),
        ("active", "boolean", [True, False, True], "RATE", "rate"),
        ("x", "double", [None, None, None], "MEASURE", "measure"),
        ("amount", "decimal(10,2)", [Decimal("1.50"), Decimal("1.50"), Decimal("3")], "MEASURE", "currency"),
        ("colour", "string", ["red", "red", "blue"], "DIMENSION", "category"),
        ("customer", "string", ["u", "u", "v"], "ENTITY", "entity"),
        ("tags", "array<int>", [[1], [1], [2]], None, None),
    ],
)
def test_rules(spark, name, dtype, values, role, rule):
    found = roles_of(spark, [(v,) for v in values], f"`{name}` {dtype}")[name]
    assert (found["business_role"], found["rule"]) == (role, rule)


def test_text_with_many_values_stays_text_but_is_a_dimension(spark):
    rows = [(f"v{i % 60}",) for i in range(120)]
    found = roles_of(spark, rows, "note string")["note"]
    assert (found["business_type"], found["business_role"]) == ("TEXT", "DIMENSION")
    assert list(found["aggregation"]) == ["count"]


def test_low_ratio_makes_a_category_of_many_values(spark):
    found = roles_of(spark, [(f"v{i % 60}",) for i in range(600)], "note string")["note"]
    assert found["business_type"] == "CATEGORICAL"


def test_nan_counts_as_missing(spark):
    found = roles_of(spark, [(float("nan"),), (1.0,), (None,)], "v double")["v"]
    assert (found["null_count"], found["non_null_count"], found["unique_count"]) == (2, 1, 1)


def test_long_texts_are_compared_as_a_whole(spark):
    base = "x" * 5000
    rows = [(base + "a",), (base + "b",), (base + "a",), ("short",)]
    found = roles_of(spark, rows, "body string")["body"]
    assert (found["unique_count"], found["non_null_count"]) == (3, 4)


def test_empty_table_and_odd_names(spark):
    found = roles_of(spark, [], "`a.b` double, `c``d` string")
    assert found["a.b"]["cardinality_ratio"] == 1.0
    assert found["a.b"]["business_role"] == "MEASURE"
    assert found["c`d"]["row_count"] == 0


def test_temporal_values_are_counted_exactly(spark):
    rows = [(datetime.datetime(2024, 1, 1, 0, 0, 0, i % 3),) for i in range(9)]
    for dtype in ("timestamp", "timestamp_ntz"):
        assert roles_of(spark, rows, f"at {dtype}")["at"]["unique_count"] == 3


def test_role_selection_leaves_out_redundant_columns(spark):
    rows = [("EU", "A", "EU-A", 5.0), ("US", "B", "US-B", 7.0), ("EU", "A", "EU-A", 7.0), ("US", "B", "US-B", 5.0)]
    df = spark.createDataFrame(rows, "area string, kind string, both string, amount double")
    derived = derived_columns(df, ["area", "kind", "amount"])
    assert derived == ["both"]
    roles = collect_roles(semantic_roles(column_catalog(df), derived))
    assert dimension_names(roles) == ["area", "kind"]
    assert measure_names(roles) == ["amount"]
