import pytest
from pyspark.sql import functions as F

from factloom.llm.site_quality import site_quality
from tests.llm.common import MEDIUM, plain, table


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    found = site_quality(docs, labels.where("doc_id % 2 = 0"))
    assert found.count() == docs.count()
    judged = found.join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    good = [r for r in judged if r["quality"] == 1]
    bad = [r for r in judged if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def test_sites_shrink(spark):
    good = "The other thing of this kind is what they are for and with. "
    bad = "THIS!! IS!! ALL!! NOISE!! AND!! SHOUT!! "
    texts = [good * (i % 4 + 1) for i in range(60)] + [bad * (i % 4 + 1) for i in range(60)]
    sites = ["a"] * 60 + ["b"] * 58 + ["c", None]
    docs = table(spark, texts).withColumn("source", F.array(*map(F.lit, sites))[F.col("doc_id").cast("int")])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 120, 3)] + [(None, 1), (5, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in site_quality(docs.withColumn("p", F.lit(1)), labels).collect()}
    assert found[0]["p_host"] > 0.9 and found[60]["p_host"] < 0.1
    middle = found[119]["p_host"]  # no site: the global mean
    assert 0.3 < middle < 0.7 and found[60]["p_host"] < found[118]["p_host"] < middle
    assert [found[i]["kept"] for i in (0, 59, 60, 118, 119)] == [True, True, False, False, False]


def test_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = table(spark, ["a b", None, ""], [1, None, 1])
    assert [r[1] for r in plain(site_quality(docs, labels), "doc_id", "kept")] == [True] * 3
    assert site_quality(table(spark, []), labels).collect() == []
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r["p_document"] == pytest.approx(0.5) for r in site_quality(docs, one).collect())
