"""Evidence for structured questions, from stored facts and relationships only.

What a dimension says about a metric does not depend on the question unless the question
names a value of that dimension.  The ten best facts per (dimension, metric) are therefore
ranked once, and each question picks from those short lists; only named values are joined
with the facts, by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.schemas import OBSERVATION

INFLUENCERS = 3
OBSERVATIONS = 10
PAIR = ["dimension", "metric"]

def relationship_id(dataset_id: str) -> Column:
    return F.xxhash64(F.lit(dataset_id), "column_a", "column_b", "rel_type")


def with_influencers(structured: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add ``picks``: up to three strongest dimensions, among the ones asked for if any.

    The ranked list per metric has one entry per dimension of the dataset, and there are
    as many lists as measures, which bounds the side that is broadcast.
    """
    ranked = (
        evidence.where(F.col("rel_type") == "cat_num")
        .groupBy(F.col("column_b").alias("target_metric"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.col("strength_score")).alias("order"),
                        F.col("column_a").alias("dimension"),
                        F.col("strength_score").alias("strength"),
                        "relationship_id",
                    )
                )
            ).alias("ranked")
        )
    )
    asked = F.col("dimensions")
    chosen = F.filter(
        "ranked", lambda r: (F.size(asked) == 0) | F.array_contains(asked, r["dimension"])
    )
    return structured.join(F.broadcast(ranked), "target_metric", "left").withColumn(
        "picks", F.slice(chosen, 1, INFLUENCERS)
    )


def influencers(structured: DataFrame, evidence: DataFrame) -> DataFrame:
    """The picks as rows, with the value the question names for the dimension, if any."""
    return (
        with_influencers(structured, evidence)
        .select(
            "question_id",
            "filters",
            F.col("target_metric").alias("metric"),
            F.posexplode("picks").alias("place", "pick"),
        )
        .select(
            "question_id",
            (F.col("place") + 1).alias("place"),
            F.col("pick.dimension").alias("dimension"),
            "metric",
            F.col("pick.strength").alias("strength"),
            F.col("pick.relationship_id").alias("relationship_id"),
            F.try_element_at("filters", F.col("pick.dimension")).alias("named_value"),
        )
    )


_FACT = ["fact_id", "dimension_value", "is_null", "sum", "mean", "count"]


def best_facts(stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """The ten most relevant facts per dimension and metric, if no value is named.

    Totals and strengths have one row per pair of columns, which bounds what is broadcast.
    """
    strengths = evidence.where(F.col("rel_type") == "cat_num").select(
        F.col("column_a").alias("dimension"),
        F.col("column_b").alias("metric"),
        F.col("strength_score").alias("strength"),
    )
    totals = stored.groupBy(*PAIR).agg(F.sum(F.abs("sum")).alias("total"))
    per_pair = strengths.join(totals, PAIR)
    order = Window.partitionBy(*PAIR).orderBy(F.desc("relevance"), "is_null", "dimension_value")
    share = F.coalesce(F.try_divide(F.abs("sum"), "total"), F.lit(0.0))
    return (
        stored.join(F.broadcast(per_pair), PAIR)
        .withColumn("contribution", share)
        .withColumn("relevance", F.col("strength") * share)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= OBSERVATIONS)
        .select(*PAIR, *_FACT, "contribution")
    )


def ranked_observations(structured: DataFrame, stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """The ten most relevant observations per question as an array, best first.

    A question brings together at most three short lists of ten, or the facts whose value
    equals the one it names up to letter case; all of it meets in one shuffle by question.
    """
    chosen = influencers(structured, evidence)
    general = (
        chosen.where(F.col("named_value").isNull())
        .drop("named_value")
        # Ten rows per pair of columns; by pair, most questions would meet in a few tasks.
        .join(F.broadcast(best_facts(stored, evidence)), PAIR)
    )
    named = (
        chosen.where(F.col("named_value").isNotNull())
        .withColumn("folded", F.lower("named_value"))
        .drop("named_value")
        .join(stored.select(*PAIR, *_FACT, F.lower("dimension_value").alias("folded")), [*PAIR, "folded"])
        .drop("folded")
        .withColumn("contribution", F.lit(None).cast("double"))
    )
    candidate = F.struct("place", *PAIR, "strength", "relationship_id", *_FACT, "contribution")

    def finished(c: Column, all_candidates: Column) -> Column:
        total = F.aggregate(
            F.filter(all_candidates, lambda o: o["place"] == c["place"]),
            F.lit(0.0),
            lambda acc, o: acc + F.abs(o["sum"]),
        )
        share = F.coalesce(c["contribution"], F.try_divide(F.abs(c["sum"]), total), F.lit(0.0))
        return F.struct(
            (-c["strength"] * share).alias("order"),
            c["place"].alias("place"),
            c["is_null"].alias("is_null"),
            c["dimension_value"].alias("dimension_value"),
            share.alias("share"),
            c.alias("fact"),
        )

    def observation(o: Column, index: Column) -> Column:
        fact = o["fact"]
        return F.struct(
            (index + 1).alias("position"),
            fact["fact_id"].alias("fact_id"),
            fact["relationship_id"].alias("relationship_id"),
            F.concat(fact["dimension"], F.lit(": "), fact["dimension_value"]).alias("factor"),
            fact["dimension"].alias("dimension"),
            fact["dimension_value"].alias("dimension_value"),
            fact["metric"].alias("metric"),
            fact["sum"].alias("metric_value"),
            fact["mean"].alias("metric_mean"),
            fact["count"].alias("row_count"),
            fact["strength"].alias("relationship_strength"),
            o["share"].alias("contribution_score"),
            (fact["strength"] * o["share"]).alias("relevance_score"),
            F.lit("statistical_evidence").alias("type"),
        )

    candidates = F.col("candidates")
    best = F.slice(
        F.sort_array(F.transform(candidates, lambda c: finished(c, candidates))), 1, OBSERVATIONS
    )
    return (
        general.unionByName(named)
        .groupBy("question_id")
        .agg(F.collect_list(candidate).alias("candidates"))
        .select("question_id", F.transform(best, observation).alias("observations"))
    )


def observations(structured: DataFrame, stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """The most relevant observations, one row each."""
    ranked = ranked_observations(structured, stored, evidence)
    return ranked.select("question_id", F.inline("observations"))


def evidence_packages(structured: DataFrame, stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per question: its structure and its evidence package."""
    structure = [
        "intent", "target_metric", "dimensions", "filters", "time_period", "comparison_period",
        "granularity",
    ]
    none = F.array().cast(f"array<{OBSERVATION}>")
    return (
        with_influencers(structured, evidence)
        .join(ranked_observations(structured, stored, evidence), "question_id", "left")
        .select(
            "question_id",
            "query_text",
            F.struct(*structure).alias("structure"),
            F.struct(
                F.col("target_metric").alias("main_metric"),
                "intent",
                F.col("filters").alias("filters_applied"),
                F.coalesce("picks.dimension", F.array().cast("array<string>")).alias(
                    "influencers_considered"
                ),
                F.coalesce(F.col("observations").cast(f"array<{OBSERVATION}>"), none).alias(
                    "observations"
                ),
            ).alias("evidence_package"),
        )
    )
