"""One query per operator, over whole tables.  Money is rounded to 4 digits, ratios to 9,
because the order of additions differs between engines."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom import Workspace
from factloom.functions.columns import fact_hash, fact_key_json, lenient_double, normalise_text
from factloom.operators import (
    catalog, cube, impact, profile, questions as asking, relationships as rel, retrieval,
)
from factloom.operators.derived import derived_columns
from factloom.plans.pipeline import build_knowledge
from factloom.sources.csv import scan_csv
from factloom.sources.tables import materialise, scratch_dir
from factloom.streaming.arrivals import watch_inbox
from workloads import views
from workloads.prepared import SALES_ID, Prepared, prepared

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query, name: str | None = None) -> Query:
    _QUERIES[name or function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(column: str | Column, digits: int = 4, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    # Means of few decimals often end in an exact 5; a small shift keeps them off the half.
    return (F.round(c + 0.0123 * 10**-digits, digits) + F.lit(0.0)).alias(name or column)


def _stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- discovery ------------------------------------------------------------------------


@query
def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(
        [
            t.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(n).alias("table_name"),
                "row_count",
                F.lit(len(t.columns)).cast("bigint").alias("column_count"),
            )
            for n in TABLES
            for t in [views.table(spark, sf_dir, n)]
        ]
    )


@query
def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return catalog.column_catalog(p.sales).select(
        "ordinal", "name", "technical_type", "row_count", "non_null_count", "unique_count",
        "null_count", "is_nullable", rounded("cardinality_ratio", 9),
    )


@query
def lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 3
    whole = F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(kind == 0, F.col("l_returnflag"))
        .when(kind == 1, F.col("l_extendedprice").cast("string"))
        .otherwise(F.concat(whole, F.lit("e1")))
    )
    # Numbers to Java only.
    text = (
        F.when(F.col("l_linenumber") == 4, F.concat(whole, F.lit("d")))
        .when(F.col("l_linenumber") == 5, F.concat(whole, F.lit("F")))
        .when(F.col("l_linenumber") == 6, "0x1p3")
        .otherwise(text)
    )
    number = lenient_double(F.col("written"), line.schema["l_returnflag"].dataType)
    return (
        line.select("l_returnflag", text.alias("written"))
        .groupBy("l_returnflag")
        .agg(
            F.count("written").alias("written"),
            F.count(number).alias("parsed"),
            F.sum(number).alias("total"),
        )
        .select("l_returnflag", "written", "parsed", rounded("total", 2))
    )


_ROLE_COLUMNS = [
    "ordinal", "name", "rule", "data_type", "business_type", "business_role", "unit",
]


@query
def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    described = catalog.semantic_roles(catalog.column_catalog(p.sales), p.derived)
    return described.select(
        *_ROLE_COLUMNS,
        F.array_join("aggregation", ",").alias("aggregation"),
        "is_derived",
        "is_redundant",
    )


@query
def semantic_roles_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stack(
        [
            catalog.semantic_roles(
                catalog.column_catalog(views.table(spark, sf_dir, n))
            ).select(F.lit(n).alias("table_name"), *_ROLE_COLUMNS, "non_null_count", "unique_count")
            for n in TABLES
        ]
    )


@partial(query, name="derived_columns")
def derived_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derived_columns(prepared(spark, sf_dir).sales, views.SALES_ORDER)
    return spark.createDataFrame([(n,) for n in found], "name string")


@query
def role_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return catalog.role_columns(
        catalog.semantic_roles(catalog.column_catalog(p.sales), p.derived)
    )


# -- profile --------------------------------------------------------------------------


@query
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.column_catalog(prepared(spark, sf_dir).sales).select(
        "name", "unique_count", "null_count"
    )


def _summary(df: DataFrame, names: list[str]) -> DataFrame:
    return profile.numeric_summary(df, names).select(
        "name",
        *[rounded(c) for c in ("mean", "median", "min_val", "max_val", "std_dev")],
    )


@query
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _summary(p.sales, p.measures_and_rates)


@query
def profile_numeric_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.table(spark, sf_dir, "lineitem")
    return _summary(line, ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _outliers(df: DataFrame, names: list[str]) -> DataFrame:
    return profile.iqr_outliers(df, names).select(
        "name", rounded("q1"), rounded("q3"), "outlier_count"
    )


@query
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _outliers(p.sales, p.measures_and_rates)


@query
def iqr_outliers_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outliers(views.table(spark, sf_dir, "events"), ["user_id", "value"])


def _bins(df: DataFrame, names: list[str]) -> DataFrame:
    return profile.histogram(df, names).select(
        "name", "bin", rounded("lo"), rounded("hi"), "label", "n"
    )


@query
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _bins(p.sales, p.measures_and_rates)


@query
def histogram_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(views.table(spark, sf_dir, "events"), ["user_id", "value"])


@query
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    names = [r.name for r in p.roles if r.business_type == "CATEGORICAL"]
    return profile.top_values(p.sales, names).select("name", "rank", "value", "n")


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _profile_rows(profile.column_profile(p.sales, p.roles))


def _profile_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ordinal",
        "name",
        *[rounded(c) for c in ("mean", "median", "min_val", "max_val", "std_dev")],
        "unique_count",
        "null_count",
        "outlier_count",
        F.array_join("distribution.labels", "|").alias("labels"),
        F.array_join(F.col("distribution.values").cast("array<string>"), "|").alias("counts"),
    )


# -- relationships --------------------------------------------------------------------


def _sales_cube(p: Prepared, several_uses: bool = False) -> DataFrame:
    cubed = cube.cube(p.sales, p.dimensions, p.measures_and_rates)
    return materialise(cubed, "cube") if several_uses else cubed


def _documents_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return materialise(cube.cube(documents, ["text", "lang", "source"], ["n_chars"]), "cube")


@query
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.group_stats(_sales_cube(prepared(spark, sf_dir))).select(
        "dimension", "metric", "value", rounded("mean"), "count", rounded("std")
    )


@query
def group_means_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means behind every stored relationship of a dimension and a measure."""
    return prepared(spark, sf_dir).workspace.all_group_means(SALES_ID).select(
        "dimension", "metric", "value", rounded("mean"), "count"
    )


@query
def cat_num_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = rel.group_stats(_sales_cube(prepared(spark, sf_dir)))
    return rel.variation(groups).select(
        "dimension", "metric", "group_count", rounded("global_mean"), rounded("strength_score", 9)
    )


@query
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = rel.group_stats(_sales_cube(prepared(spark, sf_dir), True))
    return rel.anova(groups).select(
        "dimension", "metric", "df_between", "df_within", rounded("f_statistic", 6)
    )


@query
def anova_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.category_evidence(_sales_cube(prepared(spark, sf_dir), True)).select(
        F.col("column_a").alias("dimension"),
        F.col("column_b").alias("metric"),
        rounded("significance_score", 6, "p_value"),
    )


@query
def top_contributor(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = rel.group_stats(_sales_cube(prepared(spark, sf_dir)))
    return rel.top_contributor(groups).select(
        "dimension", "metric", "top_contributor", rounded("top_mean")
    )


@query
def num_num_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return rel.correlations(p.sales, p.measures_and_rates).select(
        "column_a", "column_b", "n", rounded("correlation", 9)
    )


@query
def pearson_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return rel.correlations(p.sales, p.measures_and_rates).select(
        "column_a",
        "column_b",
        rounded(rel.correlation_p_value(F.col("correlation"), F.col("n")), 6, "p_value"),
    )


@query
def num_num_corr_infinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infinities next to gaps concern no pair; in a complete row they leave it without a correlation."""
    last = F.col("l_linenumber") == 7
    line = views.table(spark, sf_dir, "lineitem").select(
        F.when(last, float("inf")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(~last, F.col("l_extendedprice")).alias("price"),
        F.when(last, float("-inf")).otherwise(F.col("l_tax")).alias("tax"),
        F.col("l_partkey").alias("part"),
    )
    found = rel.correlations(line, line.columns).where(~F.isnan("correlation"))
    return found.select("column_a", "column_b", "n", rounded("correlation", 9))


def _evidence(rows: DataFrame) -> DataFrame:
    return rows.select(
        "column_a",
        "column_b",
        "rel_type",
        rounded("strength_score", 9),
        rounded("significance_score", 6),
        "top_contributor",
        rounded("correlation", 9),
    )


@query
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _evidence(rel.relationships(p.sales, _sales_cube(p, True), p.measures_and_rates))


@query
def relationships_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as one of the dimensions."""
    cubed = _documents_cube(spark, sf_dir)
    return (
        rel.category_evidence(cubed)
        .withColumn("top_contributor", F.md5("top_contributor"))
        .select(
            "column_a",
            "column_b",
            rounded("strength_score", 9),
            rounded("significance_score", 6),
            "top_contributor",
        )
    )


@query
def relationships_min_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(prepared(spark, sf_dir).workspace.relationships(SALES_ID, 0.01))


# -- facts ----------------------------------------------------------------------------


def _fact_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "dimension", "dimension_value", "metric", rounded("sum"), rounded("mean"), "count"
    )


@query
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _fact_rows(cube.facts(p.sales, p.dimensions, p.measures))


@query
def facts_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.table(spark, sf_dir, "documents")
    return _fact_rows(cube.facts(documents, ["text", "lang", "source"], ["n_chars"]))


@query
def facts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact_rows(
        cube.facts(views.table(spark, sf_dir, "events"), ["event_type", "props"], ["value"])
    )


@query
def facts_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    return _fact_rows(cube.nonnull_facts(p.sales, p.dimensions, p.measures))


@query
def facts_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without dimensions, measures or usable numbers there are no facts."""
    p = prepared(spark, sf_dir)
    gaps = p.sales.withColumn("quantity", F.lit(None).cast("double"))
    cases = {
        "no dimension": cube.facts(p.sales, [], p.measures),
        "no measure": cube.facts(p.sales, p.dimensions, []),
        "no number": cube.facts(gaps, ["region"], ["quantity"]),
        "one of each": cube.facts(p.sales, ["region"], ["quantity"]),
    }
    counted = [
        rows.agg(F.count(F.lit(1)).alias("fact_rows")).withColumn("case_name", F.lit(name))
        for name, rows in cases.items()
    ]
    return _stack(counted)


@query
def facts_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored facts, their identifiers, and identifiers that stand for two of them."""
    by_id = (
        prepared(spark, sf_dir).stored("fact_combinations")
        .groupBy("fact_id")
        .agg(F.countDistinct("dimension", "dimension_value").alias("facts"), F.count(F.lit(1)).alias("n"))
    )
    return by_id.agg(
        F.sum("n").alias("fact_rows"),
        F.count(F.lit(1)).alias("fact_ids"),
        F.count_if(F.col("facts") > 1).alias("shared_ids"),
    )


@query
def facts_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    rows = cube.facts_as_maps(cube.facts(p.sales, p.dimensions, p.measures))
    return rows.select(
        F.map_keys("dimensions")[0].alias("dimension"),
        F.map_values("dimensions")[0].alias("dimension_value"),
        F.size("metrics").cast("bigint").alias("entries"),
        *[
            rounded(F.col("metrics")[f"{m}_{s}"], 4, f"{m}_{s}")
            for m in ("quantity", "sales_amount", "net_amount")
            for s in ("sum", "mean", "count")
        ],
    )


@partial(query, name="fact_hash")
def fact_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    d, v = F.col("dimension"), F.col("dimension_value")
    return (
        cube.facts(p.sales, p.dimensions, ["quantity"])
        .select(d, v, fact_key_json(d, v).alias("key_json"), fact_hash(d, v).alias("fact_id"))
    )


@query
def facts_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).workspace.facts(SALES_ID, "customer_name", 1000).select(
        "fact_id",
        F.col("dimensions")["customer_name"].alias("customer_name"),
        rounded(F.col("metrics")["sales_amount_sum"], 4, "sales_amount_sum"),
        F.col("metrics")["sales_amount_count"].cast("bigint").alias("sales_amount_count"),
    )


# -- impact ---------------------------------------------------------------------------


def _impact_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "dimension",
        "metric",
        "dimension_value",
        rounded("sum"),
        rounded("mean"),
        "count",
        rounded("global_mean"),
        rounded("impact", 2),
        *[c for c in rows.columns if c == "source"],
    )


@query
def evidence_from_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = prepared(spark, sf_dir).stored("fact_combinations")
    return _impact_rows(impact.evidence_from_facts(stored, "sales_amount", "return_flag"))


@query
def evidence_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = prepared(spark, sf_dir).sales
    return _impact_rows(impact.evidence_from_rows(sales, "sales_amount", "customer_name", 100))


@query
def evidence_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = prepared(spark, sf_dir).workspace
    return _impact_rows(
        workspace.evidence(SALES_ID, "sales_amount", "region").unionByName(
            workspace.evidence(SALES_ID, "sales_amount", "region_segment", 30)
        )
    )


@query
def impact_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _impact_rows(impact.impact(prepared(spark, sf_dir).stored("fact_combinations")))


@query
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).workspace.schema(SALES_ID).select(
        "ordinal", "name", "data_type", "business_role", "is_nullable", "is_derived",
        "is_redundant", "unique_count", "null_count", rounded("mean"), rounded("std_dev"),
    )


# -- questions ------------------------------------------------------------------------


@query
def questions_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.questions(spark, sf_dir).select(
        "question_id", normalise_text(F.col("query_text")).alias("text")
    )


@query
def questions_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking.rejected(views.questions(spark, sf_dir)).select(
        "question_id", F.length("query_text").cast("bigint").alias("length")
    )


@query
def question_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = normalise_text(F.col("query_text"))
    return asking.accepted(views.questions(spark, sf_dir)).select(
        "question_id", asking.intent(text).alias("intent")
    )


@query
def question_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = normalise_text(F.col("query_text"))
    return asking.accepted(views.questions(spark, sf_dir)).select(
        "question_id",
        asking.time_period(text).alias("time_period"),
        asking.comparison_period(text).alias("comparison_period"),
        asking.granularity(text).alias("granularity"),
    )


@query
def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    asked = views.questions(spark, sf_dir)
    known = asking.terms(p.roles, p.stored("fact_combinations"), asked)
    return asking.mentions(asked, known).select("question_id", "kind", "name", "value").distinct()


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).workspace.structure(SALES_ID, views.questions(spark, sf_dir))


@query
def question_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = F.array_sort(F.map_entries("filters"))
    return _structured(spark, sf_dir).select(
        "question_id",
        "intent",
        "target_metric",
        F.array_join("dimensions", ",").alias("dimensions"),
        F.array_join(
            F.transform(filters, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("filters"),
        "time_period",
        "comparison_period",
        "granularity",
    )


@query
def question_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).select(
        "question_id", F.posexplode("dimensions").alias("place", "dimension")
    )


@query
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _structured(spark, sf_dir).select(
        "question_id", F.explode("filters").alias("dimension", "value")
    )


@query
def influencers_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = prepared(spark, sf_dir).stored("pairwise_evidence")
    return retrieval.influencers(_structured(spark, sf_dir), evidence).select(
        "question_id", "place", "dimension", "metric", rounded("strength", 9)
    )


@query
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prepared(spark, sf_dir)
    structured = materialise(_structured(spark, sf_dir), "structures")
    return retrieval.observations(
        structured, p.stored("fact_combinations"), p.stored("pairwise_evidence")
    ).select(
        "question_id",
        "position",
        "fact_id",
        "factor",
        "metric",
        rounded("metric_value"),
        rounded("metric_mean"),
        "row_count",
        rounded("relationship_strength", 9),
        rounded("contribution_score", 9),
        rounded("relevance_score", 9),
    )


def _package_columns(rows: DataFrame) -> DataFrame:
    package = F.col("evidence_package")
    return rows.select(
        "question_id",
        F.col("structure.intent").alias("intent"),
        package["main_metric"].alias("main_metric"),
        F.array_join(package["influencers_considered"], ",").alias("influencers"),
        F.size(package["observations"]).cast("bigint").alias("observation_count"),
        F.get(package["observations"], F.lit(0))["factor"].alias("first_factor"),
    )


@query
def refused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns that evidence is refused for, because of their roles."""
    roles = prepared(spark, sf_dir).roles

    def refused(metric: str, dimension: str) -> bool:
        try:
            impact.check_roles(roles, metric, dimension)
        except ValueError:
            return True
        return False

    pairs = [(m.name, d.name) for m in roles for d in roles if refused(m.name, d.name)]
    return spark.createDataFrame(pairs, "metric string, dimension string")


@query
def evidence_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.questions(spark, sf_dir)
    return _package_columns(prepared(spark, sf_dir).workspace.answer(SALES_ID, asked))


@query
def answers_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all questions, written and read back."""
    workspace = prepared(spark, sf_dir).workspace
    asked = views.questions(spark, sf_dir)
    return _package_columns(workspace.ask(SALES_ID, asked, batch="all"))


# -- sources, store, pipeline -----------------------------------------------------------


@query
def scan_csv_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as CSV with missing-value texts, read back with inferred types."""
    orders = views.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    written = orders.select(
        "o_orderkey",
        F.when(key % 7 == 0, "N/A").when(key % 7 == 1, "nan").otherwise(F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.when(key % 5 == 0, "NULL").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("is_even"),
        F.when(key % 11 == 0, F.when(key % 2 == 0, "true").otherwise("TRUE"))
        .when(key % 11 == 1, None).otherwise("false").alias("maybe"),
        # Beyond 64 bits, and beyond 63.
        F.concat(F.lit("9999999999999999"), (10000 + key % 7).cast("string")).alias("account"),
        F.when(key % 3 == 0, "18446744073709551615").otherwise(key.cast("string")).alias("unsigned_key"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('", please')).alias("priority"),
    )
    path = scratch_dir(spark, "csv")
    written.write.option("header", True).option("escape", '"').csv(path)
    return scan_csv(spark, path)


@query
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given tables registered, one of them processed."""
    workspace = Workspace(spark, scratch_dir(spark, "registry"))
    for name in TABLES:
        workspace.register(f"{sf_dir}/{name}.parquet", "parquet", dataset_id=name)
    workspace.process("customer")
    return workspace.datasets().select(
        "dataset_id", "name", "format", "status", "row_count", F.col("column_count").cast("bigint")
    )


@query
def store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of one dataset replaced by those of fewer dimensions; another one is kept."""
    p = prepared(spark, sf_dir)
    store = Workspace(spark, scratch_dir(spark, "overwrite")).store
    for dataset_id, dimensions in (
        ("first", ["region", "segment"]), ("second", ["priority"]), ("first", ["segment"]),
    ):
        rows = cube.with_fact_hash(cube.facts(p.sales, dimensions, ["quantity"]))
        store.replace("fact_combinations", dataset_id, rows, split_by="dimension")
    return store.read("fact_combinations").select(
        "dataset_id", "dimension", "dimension_value", rounded("sum"), "count"
    )


@query
def knowledge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole knowledge build; rows per knowledge table."""
    p = prepared(spark, sf_dir)
    workspace = Workspace(spark, scratch_dir(spark, "build"))
    build_knowledge(workspace.store, "sales", p.sales, views.SALES_ORDER)
    return _stack(
        [
            workspace.store.read(t, "sales")
            .agg(F.count(F.lit(1)).alias("row_count"))
            .select(F.lit(t).alias("table_name"), "row_count")
            for t in (
                "column_metadata", "column_stats", "group_statistics", "pairwise_evidence",
                "fact_combinations",
            )
        ]
    )


@query
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many asked datasets can be asked: one is processed, one not yet, the others are unknown."""
    store = prepared(spark, sf_dir).workspace.store
    store.log_status("waiting", "processing", name="waiting")
    events = views.table(spark, sf_dir, "events")
    asked = events.select(
        F.when(F.col("event_type") == "click", SALES_ID)
        .when(F.col("event_type") == "view", "waiting")
        .otherwise(F.col("event_type"))
        .alias("dataset_id")
    )
    return store.readiness(asked).groupBy("dataset_id", "readiness").agg(F.count(F.lit(1)).alias("asked"))


# -- knowledge that grows ---------------------------------------------------------------


def _grown(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A knowledge table of sales that came in three parts, the last two of them appended."""
    return prepared(spark, sf_dir).grown[0].snapshot(SALES_ID).read(table)


@query
def appended_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fact_rows(_grown(spark, sf_dir, "fact_combinations"))


@query
def appended_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(_grown(spark, sf_dir, "pairwise_evidence"))


@query
def appended_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_rows(_grown(spark, sf_dir, "column_stats"))


@query
def appended_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grown(spark, sf_dir, "column_metadata").select(
        *_ROLE_COLUMNS, F.array_join("aggregation", ",").alias("aggregation"), "is_derived", "is_redundant"
    )


@query
def pinned_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the first part, read after the others came, next to those of all."""
    workspace, pinned = prepared(spark, sf_dir).grown
    states = {"pinned": pinned, "latest": workspace.snapshot(SALES_ID)}
    return _stack(
        [_fact_rows(at.read("fact_combinations")).withColumn("state", F.lit(name)) for name, at in states.items()]
    )


@query
def arrival_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All given tables announced in an inbox and processed by a stream; one path does not exist."""
    base = scratch_dir(spark, "arrivals")
    workspace = Workspace(spark, f"{base}/knowledge")
    spark.createDataFrame(
        [
            (n, f"{sf_dir}/{n}.parquet", "parquet", n)
            for n in [*TABLES, "missing_table"]
        ],
        "dataset_id string, path string, format string, name string",
    ).write.json(f"{base}/inbox")
    stream = watch_inbox(workspace, f"{base}/inbox", f"{base}/progress")
    stream.awaitTermination()
    return workspace.datasets().select(
        "dataset_id", "status", "row_count", F.col("column_count").cast("bigint")
    )
