"""Column discovery and business semantics.

The counts of equal values yield everything the naming and cardinality rules need: every
column of a stored table is read and counted by itself, any other table is unpivoted to
(column, value) pairs in one pass, and the counts are folded to one row per column.  Equal
values collapse on the map side first, so a value that fills a third of the table is a
single row by the time it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.functions.columns import (
    NULL_TEXT,
    col,
    is_numeric,
    is_profiled,
    is_temporal,
    is_text,
    nan_to_null,
)
from factloom.sources.tables import is_scan, scan_bytes

# The vocabulary of the naming rules.
IDENTIFIER_TOKENS = ["id", "key", "code", "number"]
TIME_WORDS = ["date", "time"]
CURRENCY_WORDS = ["price", "amount", "sales", "revenue", "cost"]
RATE_WORDS = ["discount", "rate", "percent"]
ENTITY_WORDS = ["rep", "employee", "customer"]
CATEGORY_MAX_VALUES = 50
CATEGORY_MAX_RATIO = 0.2

# Longer text is counted by the SHA-256 digest of all of it, so that whole documents are
# compared without being shuffled.  A digest has 64 characters, which keeps it apart
# from any text that is short enough to be counted as it is.
SHORT_TEXT_BYTES = 63

#: The most parts that the columns of one table are read in; each is a plan of its own.
SCANS = 32
#: Files up to this size are read at once for a catalog: a plan per column would cost more than it saves.
ONE_PASS_BYTES = 64 << 20


@dataclass(frozen=True)
class ColumnRole:
    """Driver-side view of one catalog row; the catalog has one row per column."""

    ordinal: int
    name: str
    technical_type: str
    business_type: str | None
    business_role: str | None
    is_redundant: bool
    row_count: int
    non_null_count: int
    unique_count: int | None
    has_null_text: bool
    has_long_text: bool = False


def _kind(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "numeric"
    if is_temporal(dtype):
        return "temporal"
    return "text" if is_text(dtype) else "complex"


def _typed_slots(column: Column, dtype: T.DataType) -> dict[str, Column]:
    """Slots (typed key columns) that together identify the value exactly."""
    if isinstance(dtype, T.BooleanType):
        return {"as_long": column.cast("bigint")}
    if isinstance(dtype, T.IntegralType):
        return {"as_long": column.cast("bigint")}
    if isinstance(dtype, T.DateType):
        return {"as_long": F.unix_date(column).cast("bigint")}
    if isinstance(dtype, T.TimestampType):
        return {"as_long": F.unix_micros(column)}
    if isinstance(dtype, T.TimestampNTZType):
        return {"as_ntz": column}
    if isinstance(dtype, T.DecimalType):
        return {"as_double": column.cast("double"), "as_text": column.cast("string")}
    if isinstance(dtype, T.NumericType):
        return {"as_double": column.cast("double")}
    long_text = F.octet_length(column) > SHORT_TEXT_BYTES
    return {"as_text": F.when(long_text, F.sha2(column, 256)).otherwise(column)}


_SLOT_TYPES = {
    "as_long": "bigint",
    "as_double": "double",
    "as_ntz": "timestamp_ntz",
    "as_text": "string",
}


def value_counts(df: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Distinct values of every flat column with their row counts, NULL included.

    Columns: ordinal, one typed slot per kind of value present, n.  A scan of files is read column
    by column: a task then keeps the values of one column only, under a key no wider than those.
    ``earlier`` are the stored counts of other rows of the same table, which are added: they meet
    the rows before these are counted, so all pass one shuffle.
    """
    return _value_counts(df, earlier, is_scan(df))


def _value_counts(df: DataFrame, earlier: DataFrame | None, apart: bool) -> DataFrame:
    per_column: list[tuple[int, dict[str, Column]]] = [
        (i, _typed_slots(col(f.name), f.dataType))
        for i, f in enumerate(df.schema.fields)
        if is_profiled(f.dataType)
    ]
    slots = [s for s in _SLOT_TYPES if any(s in used for _, used in per_column)] or ["as_long"]
    rows = nan_to_null(df)
    if len(per_column) < 2 or not apart:
        return _counted(rows, per_column, slots, earlier)
    parts = min(len(per_column), SCANS)
    return reduce(
        DataFrame.unionByName, [_counted(rows, per_column[k::parts], slots, earlier) for k in range(parts)]
    )


def _counted(
    rows: DataFrame, columns: list[tuple[int, dict[str, Column]]], slots: list[str], earlier: DataFrame | None
) -> DataFrame:
    """The value counts of some columns, in one pass."""

    def counted(keyed: DataFrame) -> DataFrame:
        keys = keyed.columns
        if earlier is None:
            return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        known = earlier.where(F.col("ordinal").isin([i for i, _ in columns] or [-1])).select(*keys, "n")
        return known.unionAll(keyed.select("*", F.lit(1).cast("bigint"))).groupBy(*keys).agg(F.sum("n").alias("n"))

    if len(columns) == 1:
        ordinal, used = columns[0]
        found = counted(rows.select(*[c.cast(_SLOT_TYPES[s]).alias(s) for s, c in used.items()]))
        empty = F.lit(None)
        return found.select(
            F.lit(ordinal).alias("ordinal"),
            *[(F.col(s) if s in used else empty).cast(_SLOT_TYPES[s]).alias(s) for s in slots],
            "n",
        )
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            *[used.get(s, F.lit(None)).cast(_SLOT_TYPES[s]).alias(s) for s in slots],
        )
        for i, used in columns
    ] or [F.struct(F.lit(-1).alias("ordinal"), F.lit(None).cast("bigint").alias("as_long"))]
    return counted(rows.select(F.inline(F.array(*entries))))


def column_catalog(df: DataFrame) -> DataFrame:
    """Technical facts of every column, one row each; a small table is read in a single pass."""
    apart = is_scan(df) and scan_bytes(df) > ONE_PASS_BYTES
    return catalog_of_counts(_value_counts(df, None, apart), df.schema)


def stored_counts(counted: DataFrame) -> DataFrame:
    """Value counts with every slot, as they are kept for later appends."""
    return counted.select(
        "ordinal",
        *[
            F.col(s) if s in counted.columns else F.lit(None).cast(t).alias(s)
            for s, t in _SLOT_TYPES.items()
        ],
        "n",
    )


def numeric_counts(counted: DataFrame, ordinals: list[int]) -> DataFrame:
    """(slot, v, n): the numbers of the given columns with their counts; slot is the place in the list."""
    return (
        counted.where(F.col("ordinal").isin(ordinals))
        .select(
            (F.array_position(F.lit(ordinals), F.col("ordinal")) - 1).cast("int").alias("slot"),
            F.coalesce(F.col("as_long").cast("double"), "as_double").alias("v"),
            "n",
        )
        .where(F.col("v").isNotNull())
    )


def finite_means(counted: DataFrame, ordinals: dict[str, int]) -> dict[str, float]:
    """Mean of the finite values of columns given by name and ordinal, 0 without any."""
    finite = F.abs("v") < F.lit(float("inf"))
    rows = (
        numeric_counts(counted, list(ordinals.values()))
        .where(finite)
        .groupBy("slot")
        .agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
        .collect()
        if ordinals
        else []
    )
    means = {r["slot"]: r["mean"] for r in rows}
    return {name: means.get(i, 0.0) for i, name in enumerate(ordinals)}


def catalog_of_counts(counted: DataFrame, schema: T.StructType) -> DataFrame:
    """The catalog of a table with this schema, from its value counts."""
    slots = [c for c in counted.columns if c.startswith("as_")]
    present = F.lit(False)
    for s in slots:
        present = present | col(s).isNotNull()
    numeric_ordinals = [
        i for i, f in enumerate(schema.fields) if is_numeric(f.dataType)
    ]
    number = F.coalesce(
        *[col(s).cast("double") for s in slots if s in ("as_long", "as_double")],
        F.lit(None).cast("double"),
    )
    is_null_text = (
        (F.col("as_text") == NULL_TEXT) if "as_text" in slots else F.lit(False)
    )
    is_long_text = (
        (F.octet_length("as_text") > SHORT_TEXT_BYTES) if "as_text" in slots else F.lit(False)
    )
    facts = counted.groupBy("ordinal").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.count_if(present).alias("unique_count"),
        F.max(F.when(F.col("ordinal").isin(numeric_ordinals), number)).alias("max_number"),
        F.coalesce(F.max(is_null_text), F.lit(False)).alias("has_null_text"),
        F.coalesce(F.max(is_long_text), F.lit(False)).alias("has_long_text"),
    )
    layout = counted.sparkSession.createDataFrame(
        [
            (i, f.name, f.dataType.simpleString(), _kind(f.dataType))
            for i, f in enumerate(schema.fields)
        ],
        "ordinal int, name string, technical_type string, kind string",
    )
    flat = F.col("kind") != "complex"
    return (
        layout.join(facts, "ordinal", "left")
        .select(
            "ordinal",
            "name",
            "technical_type",
            "kind",
            F.when(flat, F.coalesce("row_count", F.lit(0))).alias("row_count"),
            F.when(flat, F.coalesce("non_null_count", F.lit(0))).alias("non_null_count"),
            F.when(flat, F.coalesce("unique_count", F.lit(0))).alias("unique_count"),
            "max_number",
            F.coalesce("has_null_text", F.lit(False)).alias("has_null_text"),
            F.coalesce("has_long_text", F.lit(False)).alias("has_long_text"),
        )
        .withColumn("null_count", F.col("row_count") - F.col("non_null_count"))
        .withColumn("is_nullable", F.col("null_count") > 0)
        .withColumn(
            "cardinality_ratio",
            F.when(
                flat,
                F.coalesce(F.try_divide("unique_count", "non_null_count"), F.lit(1.0)),
            ),
        )
    )


def _name_has(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(name), '{w}')" for w in words) + ")"


_FEW_VALUES = f"(unique_count < {CATEGORY_MAX_VALUES} or cardinality_ratio < {CATEGORY_MAX_RATIO}D)"

# The rules in the order in which they are tried.
_RULE = f"""
case when kind = 'complex' then null
     when arrays_overlap(
            split(replace(lower(name), '-', '_'), '_'),
            array({", ".join(f"'{t}'" for t in IDENTIFIER_TOKENS)})) then 'identifier_name'
     when unique_count = non_null_count and unique_count > 0 then 'identifier_unique'
     when kind = 'temporal' or {_name_has(TIME_WORDS)} then 'time'
     when kind = 'numeric' and {_name_has(CURRENCY_WORDS)} then 'currency'
     when kind = 'numeric' and ({_name_has(RATE_WORDS)} or coalesce(max_number <= 1, false)) then 'rate'
     when kind = 'numeric' then 'measure'
     when {_FEW_VALUES} and {_name_has(ENTITY_WORDS)} then 'entity'
     when {_FEW_VALUES} then 'category'
     else 'text' end
"""

# Fixed values per rule: business type, business role, unit, legal aggregations.
_OUTCOMES = """
map('identifier_name',   named_struct('type', 'TEXT', 'role', 'IDENTIFIER', 'unit', null, 'aggs', array('count')),
    'identifier_unique', named_struct('type', 'TEXT', 'role', 'IDENTIFIER', 'unit', null, 'aggs', array('count')),
    'time',     named_struct('type', 'DATETIME', 'role', 'TIME_DIMENSION', 'unit', null, 'aggs', array('count')),
    'currency', named_struct('type', 'NUMERIC', 'role', 'MEASURE', 'unit', 'currency', 'aggs', array('sum', 'mean', 'median')),
    'rate',     named_struct('type', 'NUMERIC', 'role', 'RATE', 'unit', 'percentage', 'aggs', array('mean')),
    'measure',  named_struct('type', 'NUMERIC', 'role', 'MEASURE', 'unit', null, 'aggs', array('sum', 'mean')),
    'entity',   named_struct('type', 'CATEGORICAL', 'role', 'ENTITY', 'unit', null, 'aggs', array('count')),
    'category', named_struct('type', 'CATEGORICAL', 'role', 'DIMENSION', 'unit', null, 'aggs', array('count')),
    'text',     named_struct('type', 'TEXT', 'role', 'DIMENSION', 'unit', null, 'aggs', array('count')))
"""


def semantic_roles(catalog: DataFrame, derived: list[str] | None = None) -> DataFrame:
    """Add rule, business type, role, unit, legal aggregations and derived flags."""
    is_derived = F.col("name").isin(derived) if derived else F.lit(False)
    return (
        catalog.withColumn("rule", F.expr(_RULE))
        .withColumn("outcome", F.expr(f"try_element_at({_OUTCOMES}, rule)"))
        .withColumns(
            {
                "business_type": F.col("outcome.type"),
                "business_role": F.col("outcome.role"),
                "unit": F.col("outcome.unit"),
                "aggregation": F.col("outcome.aggs"),
                "data_type": F.lower("outcome.type"),
                "is_derived": is_derived,
                "is_redundant": is_derived,
            }
        )
        .drop("outcome")
    )


def collect_roles(roles: DataFrame) -> list[ColumnRole]:
    """Bring the catalog (one row per column) to the driver to compose further plans."""
    names = list(ColumnRole.__dataclass_fields__)
    rows = roles.select(*names).collect()
    return sorted((ColumnRole(**r.asDict()) for r in rows), key=lambda r: r.ordinal)


def dimension_names(roles: list[ColumnRole], with_time: bool = False) -> list[str]:
    wanted = {"DIMENSION", "ENTITY"} | ({"TIME_DIMENSION"} if with_time else set())
    return [r.name for r in roles if r.business_role in wanted and not r.is_redundant]


def measure_names(roles: list[ColumnRole], with_rates: bool = False) -> list[str]:
    wanted = {"MEASURE"} | ({"RATE"} if with_rates else set())
    return [r.name for r in roles if r.business_role in wanted]


def role_columns(roles: DataFrame) -> DataFrame:
    """Which columns each consumer uses: one row per (purpose, column)."""
    role = F.col("business_role")
    usable = ~F.col("is_redundant")
    purposes = F.array_compact(
        F.array(
            F.when(role.isin("DIMENSION", "ENTITY") & usable, F.lit("fact_dimension")),
            F.when(
                role.isin("DIMENSION", "ENTITY", "TIME_DIMENSION") & usable,
                F.lit("question_dimension"),
            ),
            F.when(role == "MEASURE", F.lit("fact_measure")),
            F.when(role.isin("MEASURE", "RATE"), F.lit("evidence_measure")),
        )
    )
    return roles.select(F.explode(purposes).alias("purpose"), "ordinal", "name")
