"""A training corpus from raw documents: filter, deduplicate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Decisions are made row by row: of a group of copies exactly one row stays,
also where rows repeat a doc_id, have none, or one doc_id stands for several texts.  Null texts count as empty, columns besides doc_id,
text, lang, source and n_chars are passed on, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.common import written
from factloom.llm.exact_dup import exact_duplicates
from factloom.llm.near_dup import near_duplicates
from factloom.llm.packing import pack
from factloom.llm.queries import vocabulary
from factloom.llm.secrets import redacted, secret_findings
from factloom.llm.site_quality import site_quality
from workloads.session import ready

#: No stage but the first two can be written in SQL: recipes, hashing and a forest are none.
ORACLE_SQL = None


#: Name of the row key while a stage decides.
ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own in the order of doc_id, rows without one last.

    That is doc_id itself, unless it is missing in a row or stands in several: only then are
    the rows put in order and written again.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).groupBy("id").count()
    if ids.where("id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    ordered = docs.orderBy(
        F.col("doc_id").asc_nulls_last(), F.xxhash64("text", "source", "lang"), F.rand(7)
    )
    return written(ordered.withColumn(ROW, F.monotonically_increasing_id()), "keyed-documents")


def _without_dropped(keyed: DataFrame, decisions: DataFrame) -> DataFrame:
    dropped = decisions.where("NOT kept").select(F.col("doc_id").alias(ROW))
    return keyed.join(dropped, ROW, "left_anti").drop(ROW)


def _by_row(keyed: DataFrame) -> DataFrame:
    return keyed.withColumn("doc_id", F.col(ROW)).drop(ROW)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that their text and site make more likely bad than good."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    keyed = _keyed(docs)
    rows = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), ROW)
    labels = labels.withColumn("doc_id", F.col("doc_id").cast("long")).join(rows, "doc_id")
    return _without_dropped(keyed, site_quality(_by_row(keyed), _by_row(labels)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of texts that are equal but for white space."""
    ready(spark)
    keyed = _keyed(docs)
    return _without_dropped(keyed, exact_duplicates(_by_row(keyed)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each component of documents that share 80 % of their five-word shingles."""
    ready(spark)
    keyed = _keyed(docs)
    return _without_dropped(keyed, near_duplicates(_by_row(keyed)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    ready(spark)
    clean = redacted(docs, secret_findings(docs))
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the tokens of all documents in sequences of 2,048."""
    ready(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
