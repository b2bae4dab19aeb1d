"""CSV scan with the type rules of a dataframe reader.

All fields are read as text; one aggregation over the file decides the type of every
column.  Spark's own inference knows a single missing-value token and no such rules.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from factloom.functions.columns import FLOATING, col

# The texts that mean "missing".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The texts that mean true and false.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

INTEGER = r"^\s*[+-]?\d+\s*$"
LARGEST_UNSIGNED = Decimal(2**64 - 1)
RECORD = "__record"


class SurplusFields(ValueError):
    """Rows with more fields than the header."""


def scan_csv(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    multi_line: bool | None = None,
) -> DataFrame:
    """Read CSV with a header row and infer a type per column.

    Integers become bigint, up to 2**64 - 1 decimal(20,0), beyond that they stay text; integers
    with gaps become double; booleans with gaps become the texts True and False.  Rows with
    fewer fields than the header are filled up with NULL; rows with more raise SurplusFields.
    Files in which a quoted field runs over a line end cannot be split; unless ``multi_line``
    says so, the lines are searched for a field that opens with a quote and does not close.
    """
    if multi_line is None:
        multi_line = _has_open_quote(spark, path, separator)
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("nullValue", "")
        .option("mode", "PERMISSIVE")
    )
    parsed = reader.csv(path).columns
    names = unique_names(_header(spark, path, separator, parsed))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = reader.option("columnNameOfCorruptRecord", RECORD).schema(schema.add(RECORD, "string")).csv(path)
    text = raw.select(
        *[
            F.when(col(f"c{i}").isin(NA_TOKENS), None).otherwise(col(f"c{i}")).alias(name)
            for i, name in enumerate(names)
        ],
        # Set for rows of another length only.
        _has_surplus(F.col(RECORD), separator, len(names)).alias(RECORD),
    )
    types = infer_types(text)
    return text.select(*[_convert(col(c), types[c]).alias(c) for c in names])


def _has_surplus(record: Column, separator: str, width: int) -> Column:
    """More separators outside quotes than a row of ``width`` fields has."""
    bare = F.regexp_replace(record, r'"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) >= width * len(separator)


def _header(spark: SparkSession, path: str, separator: str, parsed: list[str]) -> list[str]:
    """Header as written: Spark's reader adds positions to names that occur twice.

    A field without a name is called ``Unnamed: <position>``.
    """
    first = spark.read.text(path).first()
    if first is None or first[0].count('"') % 2:
        # A name with a line break in it is left to Spark's reader.
        return parsed
    schema = ", ".join(f"c{i} string" for i in range(len(parsed)))
    options = {"sep": separator, "quote": '"', "escape": '"'}
    line = spark.createDataFrame([(first[0],)], "line string")
    names = line.select(F.from_csv("line", schema, options).alias("h")).first()["h"]
    return [name or f"Unnamed: {i}" for i, name in enumerate(names)]


def unique_names(names: list[str]) -> list[str]:
    """Give repeated names the suffixes .1, .2, ... in order of appearance."""
    seen: dict[str, int] = {}
    taken = set(names)
    result = []
    for name in names:
        count = seen.get(name, 0)
        new = name
        while count and (new := f"{name}.{count}") in taken:
            count += 1
        seen[name] = count + 1
        taken.add(new)
        result.append(new)
    return result


def _has_open_quote(spark: SparkSession, path: str, separator: str) -> bool:
    """True if some line has a field that opens with a quote and does not close there.

    A quote inside an unquoted field, like an inch mark, opens nothing.
    """
    edge = re.escape(separator)
    closed = rf'(^|{edge})"([^"]|"")*"(?={edge}|$)'
    rest = F.regexp_replace("value", closed, "$1")
    return not spark.read.text(path).where(rest.rlike(rf'(^|{edge})"')).limit(1).isEmpty()


def infer_types(text: DataFrame) -> dict[str, str]:
    """Type of each text column, from one aggregation over the whole table."""
    checks = []
    names = [c for c in text.columns if c != RECORD]
    for i, c in enumerate(names):
        v = col(c)
        number = F.when(v.rlike(INTEGER), F.trim(v).try_cast("decimal(38,0)"))
        checks += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.rlike(INTEGER)).alias(f"i{i}"),
            F.count_if(v.rlike(INTEGER) & F.trim(v).try_cast("bigint").isNotNull()).alias(f"s{i}"),
            F.count_if(number.between(F.lit(0), F.lit(LARGEST_UNSIGNED))).alias(f"u{i}"),
            F.count_if(v.rlike(FLOATING)).alias(f"f{i}"),
            F.count_if(v.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}"),
        ]
    surplus = F.count_if(col(RECORD)) if RECORD in text.columns else F.lit(0)
    found = text.agg(F.count(F.lit(1)).alias("rows"), surplus.alias("surplus"), *checks).first()
    if found["surplus"]:
        raise SurplusFields(f"{found['surplus']} rows have more fields than the header")
    types = {}
    for i, c in enumerate(names):
        n, whole = found[f"n{i}"], found[f"n{i}"] == found["rows"]
        if n and found[f"b{i}"] == n:
            types[c] = "boolean" if whole else "boolean text"
        elif n and found[f"i{i}"] == n:
            if found[f"s{i}"] == n:
                types[c] = "bigint" if whole else "double"
            else:
                # A double would merge different long numbers.
                types[c] = "decimal(20,0)" if whole and found[f"u{i}"] == n else "string"
        elif found[f"f{i}"] == n:
            # Also a column without any value.
            types[c] = "double"
        else:
            types[c] = "string"
    return types


def _convert(value: Column, dtype: str) -> Column:
    if dtype == "string":
        return value
    if dtype == "boolean":
        return value.isin(TRUE_TOKENS)
    if dtype == "boolean text":
        return F.when(value.isin(TRUE_TOKENS), "True").when(value.isNotNull(), "False")
    return F.trim(value).try_cast(dtype)
