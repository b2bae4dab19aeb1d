"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm.backoff import scores
from factloom.llm.divergence import source_divergence
from factloom.llm.exact_dup import exact_duplicates
from factloom.llm.hard_negatives import hard_negatives
from factloom.llm.near_dup import near_duplicates
from factloom.llm.nearest import nearest
from factloom.llm.packing import pack
from factloom.llm.pieces import encode, with_round_trip
from factloom.llm.pii import personal_data, span_digest
from factloom.llm.rank_language import predicted_languages
from factloom.llm.secrets import secret_findings
from factloom.llm.site_quality import site_quality
from factloom.llm.url_rules import judged, rule_table

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Verdict and host/path of the rules that the query applies.
URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's verdict; values as digests."""
    found = secret_findings(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret"
    )


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(personal_data(_table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_max_plus_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each chunk's ids, and whether decoding them gives its text back."""
    pieces = vocabulary("piece_bpe_32k.model")
    encoded = encode(_table(spark, sf_dir, "documents"), pieces)
    return with_round_trip(encoded, pieces)


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_table(spark, sf_dir, "documents"))


def op8_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op11_kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh id has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("__label") + 1) % 10).otherwise(F.col("__label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its most telling terms."""
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by profiles of those that are not held out."""
    return predicted_languages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_secret_forest,
            op2_redirect_equivalence,
            op3_skip_chain_pii,
            op4_best_fit_packing,
            op5_max_plus_pieces,
            op6_site_quality,
            op7_backoff_automaton,
            op8_one_permutation_minhash,
            op9_exact_dedup,
            op10_adaptive_scan,
            op11_kronecker_negatives,
            op12_source_divergence,
            op13_rank_order_language,
        )
    }


def oracle_sql() -> dict[str, str]:
    from factloom.llm.oracle import STATEMENTS

    return dict(STATEMENTS)
