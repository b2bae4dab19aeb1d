import random

from factloom.llm.components import connected_components
from tests.llm.common import union_find


def groups(spark, edges):
    found = connected_components(spark.createDataFrame(edges, "x long, y long")).collect()
    assert len(found) == len({r["node"] for r in found})
    return {r["node"]: r["component"] for r in found}


def test_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert groups(spark, edges) == union_find(linked, [e for e in edges if e[0] != e[1]])


def test_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(0, 70)]
    hub = [(1000, i) for i in range(1001, 1400)]
    found = groups(spark, chain + hub)
    assert {found[i] for i in range(71)} == {0} and {found[i] for i in range(1000, 1400)} == {1000}


def test_nothing_to_link(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(1, 1), (None, 2), (2, None)]) == {}
