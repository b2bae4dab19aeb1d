"""Every registered query against its SQL counterpart on whole tables."""

import pytest

from workloads import compare, oracle, registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


def test_every_query_has_a_counterpart():
    assert set(registry.queries()) == set(oracle.statements())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, connection, name):
    same, note = compare.compare(spark, SF, name, connection)
    assert same, note


def test_flagship(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 5 and {r["dimension"] for r in rows} == {"region"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
