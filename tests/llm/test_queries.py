"""Registration, SQL counterparts on whole tables, and the pipeline against plain code."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import queries
from factloom.llm.queries import vocabulary
from factloom.llm.site_quality import site_quality
from tests.llm.common import MEDIUM, SMALL, DOCS, near_groups, plain, table
from workloads import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    result = queries.queries()[name](spark, MEDIUM)
    cursor = compare.connect(MEDIUM).execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    assert compare.rows_of(result.columns, result.collect()) == compare.rows_of(columns, cursor.fetchall())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {*queries.queries(), "pipeline"} <= names
    assert [n for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [
        n for i in range(1, 14) for n in queries.queries() if n.startswith(f"op{i}_")
    ]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, SMALL)
    bad = {i for i, k in plain(site_quality(docs, labels), "doc_id", "kept") if not k}
    texts = {i: t for i, t in plain(docs, "doc_id", "text") if i not in bad}
    assert bad and dict(plain(kept, "doc_id", "text")) == texts and kept.columns == docs.columns

    unique = stages["exact dedup"](spark, kept, SMALL)
    best = {}
    for i, t in sorted(texts.items()):
        key = re.sub(r"[ \t-\r]", "", t)
        if key not in best or len(t) > len(texts[best[key]]):
            best[key] = i
    texts = {i: texts[i] for i in best.values()}
    assert dict(plain(unique, "doc_id", "text")) == texts

    apart = stages["near dedup"](spark, unique, SMALL)
    groups = near_groups(list(texts.items()), 5)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    assert dict(plain(apart, "doc_id", "text")) == texts

    clean = stages["secret scans"](spark, apart, SMALL)
    texts = {i: re.sub(r'token = "[0-9a-f]{40}"', 'token = "[secret]"', t) for i, t in texts.items()}
    assert dict(plain(clean, "doc_id", "text")) == texts and clean.columns == docs.columns
    assert dict(plain(clean, "doc_id", "n_chars")) == {i: len(t) for i, t in texts.items()}

    packed = stages["best-fit packing"](spark, clean, SMALL)
    assert {r[0] for r in plain(packed, "doc_id")} == set(texts)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert plain(corpus_pipeline.run(spark, SMALL), *columns) == plain(packed, *columns)


def test_pipeline_of_nothing_and_of_nulls(spark):
    for data in ([], [(None, None, None, None, None), (1, None, None, None, 0), (None, "a b", "en", "s", 3)]):
        docs = spark.createDataFrame(data, DOCS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.packing(spark, docs, SMALL).count() >= bool(data)
    assert vocabulary("word_bpe_49k.json").endswith(".json")


def test_one_row_of_each_group_stays(spark):
    stages = dict(corpus_pipeline.STAGES)
    long = [" ".join(f"w{n}x{i}" for i in range(60)) for n in range(4)]
    near = long[0] + " more"
    texts = [long[0]] * 3 + [long[1], long[1], long[2], long[1], long[3], long[3]]
    docs = table(spark, texts, [1, 1, 1, 2, 3, 3, None, None, None])
    once = [(1, long[0]), (2, long[1]), (3, long[2]), (None, long[3])]
    want = sorted(once, key=lambda r: (r[0] is not None, r[0] or 0))
    for name in ("exact dedup", "near dedup"):
        assert plain(stages[name](spark, docs, SMALL), "doc_id", "text") == want
    close = table(spark, [long[0], near, near, long[2]], [1, None, 5, 5])
    assert plain(stages["near dedup"](spark, close, SMALL), "doc_id", "text") == [(1, long[0]), (5, long[2])]


def test_quality_decides_rows_without_an_id(spark):
    quality = dict(corpus_pipeline.STAGES)["quality classifier"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    fresh = docs.withColumn("doc_id", F.lit(None).cast("long"))
    stay = sorted(r["text"] for r in quality(spark, docs.unionByName(fresh), SMALL).where("doc_id IS NULL").collect())
    assert 0 < len(stay) < docs.count()
