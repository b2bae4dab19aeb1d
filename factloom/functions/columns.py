"""Column expressions shared by every operator.  All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NULL_TEXT = "(null)"

# Fixed value: the characters that count as part of a word (letters, digits and
# underscore in any script).
WORD_CLASS = r"[\p{L}\p{N}_]"

# Fixed value: the texts that count as a number.
FLOATING = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Reference a top-level column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    """Booleans count as numbers, as they do in the dataframe world this follows."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_profiled(dtype: T.DataType) -> bool:
    """Flat values only; arrays, maps, structs, binary and intervals have no profile."""
    return is_numeric(dtype) or is_temporal(dtype) or is_text(dtype)


def lenient_double(column: Column, dtype: T.DataType) -> Column:
    """Value as a double; text that does not parse and NaN both become NULL."""
    if isinstance(dtype, T.BooleanType):
        return column.cast("int").cast("double")
    if is_text(dtype):
        # The cast alone would also take Java's suffixes (1d, 5F) and hexadecimal numbers.
        return F.when(column.rlike(FLOATING), column.try_cast("double"))
    if isinstance(dtype, _FLOATING):
        return F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    return column.cast("double")


def measure(df: DataFrame, name: str) -> Column:
    return lenient_double(col(name), df.schema[name].dataType)


def dimension_text(df: DataFrame, name: str) -> Column:
    """Dimension value as text, NULL (and NaN) kept as NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, _FLOATING):
        return F.nanvl(col(name), F.lit(None)).cast("string")
    return col(name).cast("string")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn floating NaN into NULL so that one notion of "missing" is left."""
    return df.select(
        *[
            F.nanvl(col(f.name), F.lit(None)).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, _FLOATING)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def is_finite(column: Column) -> Column:
    return F.abs(column) < F.lit(float("inf"))


def fact_key_json(dimension: Column, value: Column) -> Column:
    """The text ``{"dimension": "value"}`` with JSON escapes, ASCII only."""
    return F.concat(
        F.lit('{"'), _json_escape(dimension), F.lit('": "'), _json_escape(value), F.lit('"}')
    )


def fact_hash(dimension: Column, value: Column) -> Column:
    return F.sha2(fact_key_json(dimension, value), 256)


def _json_escape(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        plain = F.replace(plain, F.lit(raw), F.lit(short))

    def escape_char(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.when(ch.rlike("[ -~]"), ch).otherwise(
            F.regexp_replace(units, "(.{4})", "\\\\u$1")
        )

    # Only text that really has such characters pays for the per-character form.
    return F.when(
        plain.rlike("[^ -~]"),
        F.array_join(F.transform(F.split(plain, ""), escape_char), ""),
    ).otherwise(plain)


def normalise_text(text: Column) -> Column:
    """Lower case, runs of underscores and hyphens become one blank."""
    return F.regexp_replace(F.lower(text), r"[_\-]+", " ")


def contains_any(text: Column, words) -> Column:
    """True if one of the words occurs anywhere in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit
