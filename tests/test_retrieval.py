import random

import pytest

from factloom.operators import cube, relationships as rel, retrieval


def brute_force(question, facts, evidence):
    """The retrieval rule over plain lists."""
    qid, metric, dimensions, filters = question
    chosen = sorted(
        (e for e in evidence if e["column_b"] == metric and e["rel_type"] == "cat_num"
         and (not dimensions or e["column_a"] in dimensions)),
        key=lambda e: (-e["strength_score"], e["column_a"]),
    )[:3]
    seen = []
    for place, e in enumerate(chosen):
        rows = [f for f in facts if f["dimension"] == e["column_a"] and f["metric"] == metric]
        if e["column_a"] in filters:
            rows = [f for f in rows if f["dimension_value"].lower() == filters[e["column_a"]].lower()]
        total = sum(abs(f["sum"]) for f in rows)
        for f in rows:
            share = abs(f["sum"]) / total if total else 0.0
            seen.append((-e["strength_score"] * share, place, f["is_null"], f["dimension_value"], e["column_a"], share))
    seen.sort()
    return [(s[4], s[3], pytest.approx(s[5], rel=1e-9, abs=1e-12)) for s in seen[:10]]


@pytest.fixture(scope="module")
def store(spark):
    rng = random.Random(2)
    rows = [
        (rng.choice(["North", "north", "South", None]), f"c{rng.randint(1, 30)}", rng.choice("xyz"), "one",
         rng.uniform(-50, 100), 0.0)
        for _ in range(800)
    ]
    df = spark.createDataFrame(rows, "area string, client string, kind string, same string, amount double, zero double")
    cubed = cube.cube(df, ["area", "client", "kind", "same"], ["amount", "zero"])
    facts = cube.with_fact_hash(cube.facts_from_cube(cubed, ["amount", "zero"])).persist()
    evidence = rel.category_evidence(cubed).withColumn("relationship_id", retrieval.relationship_id("t")).persist()
    return facts, evidence


QUESTIONS = [
    (1, "amount", [], {}),
    (2, "amount", ["client"], {}),
    (3, "amount", ["area", "kind"], {"area": "NORTH"}),
    (4, "amount", ["area"], {"area": "nowhere"}),
    (5, "amount", ["when"], {}),
    (6, "zero", [], {}),
    (7, "missing", [], {}),
    (8, "amount", [], {"client": "c3", "area": "(null)"}),
    (9, "zero", ["same"], {"same": "one"}),
]


def structured(spark):
    rows = [(q, f"question {q}", "trend", m, d, f, None, None, "month") for q, m, d, f in QUESTIONS]
    return spark.createDataFrame(
        rows,
        "question_id int, query_text string, intent string, target_metric string, dimensions array<string>,"
        " filters map<string,string>, time_period string, comparison_period string, granularity string",
    )


def test_packages_equal_brute_force(spark, store):
    facts, evidence = store
    fact_rows, evidence_rows = facts.collect(), evidence.collect()
    packages = {
        r["question_id"]: r["evidence_package"]
        for r in retrieval.evidence_packages(structured(spark), facts, evidence).collect()
    }
    assert set(packages) == {q[0] for q in QUESTIONS}
    for question in QUESTIONS:
        package = packages[question[0]]
        got = [(o["dimension"], o["dimension_value"], o["contribution_score"]) for o in package["observations"]]
        assert got == brute_force(question, fact_rows, evidence_rows), question
        assert [o["position"] for o in package["observations"]] == list(range(1, len(got) + 1))
        assert package["filters_applied"] == question[3]
    assert packages[7]["influencers_considered"] == [] and packages[5]["observations"] == []


def test_contributions_add_up_and_ids_trace_back(spark, store):
    facts, evidence = store
    rows = retrieval.observations(structured(spark).where("question_id = 3"), facts, evidence).collect()
    by_area = [r["contribution_score"] for r in rows if r["dimension"] == "area"]
    assert sum(by_area) == pytest.approx(1.0) and len(by_area) == 2
    known = {r["fact_id"] for r in facts.select("fact_id").collect()}
    links = {r["relationship_id"] for r in evidence.select("relationship_id").collect()}
    assert all(r["fact_id"] in known and r["relationship_id"] in links for r in rows)
