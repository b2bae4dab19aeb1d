"""Column layout of the knowledge tables."""

from __future__ import annotations

_FACT_COLUMNS = (
    "dimension_ordinal int, dimension_value string, is_null boolean, metric_ordinal int,"
    " metric string, sum double, mean double, count bigint, fact_id string"
)
OBSERVATION = (
    "struct<position:int, fact_id:string, relationship_id:bigint, factor:string,"
    " dimension:string, dimension_value:string, metric:string, metric_value:double,"
    " metric_mean:double, row_count:bigint, relationship_strength:double,"
    " contribution_score:double, relevance_score:double, type:string>"
)

SCHEMAS = {
    "datasets": (
        "name string, source_path string, format string, size_bytes bigint, row_count bigint,"
        " column_count int, status string, updated_at timestamp,"
        " dataset_id string, event string"
    ),
    "column_metadata": (
        "ordinal int, name string, data_type string, python_type string, is_nullable boolean,"
        " technical_type string, kind string, business_type string, business_role string,"
        " rule string, unit string, aggregation array<string>, is_derived boolean,"
        " is_redundant boolean, row_count bigint, non_null_count bigint, unique_count bigint,"
        " has_null_text boolean, has_long_text boolean, dataset_id string"
    ),
    "column_stats": (
        "ordinal int, name string, mean double, median double, min_val double, max_val double,"
        " std_dev double, unique_count bigint, null_count bigint, outlier_count bigint,"
        " distribution struct<labels:array<string>, values:array<bigint>>, dataset_id string"
    ),
    "group_statistics": (
        "dimension_ordinal int, dimension string, value string, metric_ordinal int,"
        " metric string, sum double, mean double, count bigint, variance double,"
        " dataset_id string"
    ),
    "pairwise_evidence": (
        "column_a string, column_b string, rel_type string, strength_score double,"
        " significance_score double, top_contributor string, correlation double,"
        " relationship_id bigint, dataset_id string"
    ),
    "fact_combinations": _FACT_COLUMNS + ", dataset_id string, dimension string",
    # What later appends are merged with.
    "value_counts": (
        "ordinal int, as_long bigint, as_double double, as_ntz timestamp_ntz, as_text string,"
        " n bigint, dataset_id string"
    ),
    "long_texts": "ordinal int, digest string, value string, dataset_id string",
    "pair_sums": (
        "column_a string, column_b string, shift_a double, shift_b double, n bigint, infinite bigint,"
        " sx double, sy double, sxx double, syy double, sxy double, min_x double, max_x double,"
        " min_y double, max_y double, dataset_id string"
    ),
    "open_triples": "t int, a int, b int, n int, dataset_id string",
    "arrival_attempts": (
        "announced string, attempt int, outcome string, message string, at timestamp,"
        " dataset_id string, event string"
    ),
    "rejected_questions": (
        "question_id string, query_text string, created_at timestamp, dataset_id string, batch string"
    ),
    "analyst_queries": (
        "question_id string, query_text string,"
        " structure struct<intent:string, target_metric:string, dimensions:array<string>,"
        " filters:map<string,string>, time_period:string, comparison_period:string,"
        " granularity:string>,"
        " evidence_package struct<main_metric:string, intent:string,"
        " filters_applied:map<string,string>, influencers_considered:array<string>,"
        f" observations:array<{OBSERVATION}>>,"
        " created_at timestamp, dataset_id string, batch string"
    ),
}
