"""Text columns that are put together from two other text columns.

A column counts as derived if, on the first 20 rows (in a given total order) where it and
two other text columns are all present, its value contains both of theirs.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from factloom.functions.columns import col, is_text

SAMPLE_ROWS = 20
PREFIX_ROWS = 1000
#: Types whose values come back from the driver as they were.
_COMPARED = (T.IntegralType, T.StringType, T.DateType)


def stored_order(df: DataFrame) -> list[Column]:
    """Files by path, and rows as they stand in them.

    The position within the scan alone would put larger files first.
    """
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    try:
        df.select(*place)
    except AnalysisException:  # not a scan of files
        place = []
    return [*place, F.monotonically_increasing_id()]


def derived_columns(
    df: DataFrame,
    order_by: Sequence[str | Column] | None = None,
    whole_table: bool = False,
) -> list[str]:
    """Names of derived columns, in column order.

    ``order_by`` should be a total order; without it the stored order of the rows is used.
    With ``whole_table`` all complete rows decide instead of the first 20.
    The first thousand rows in that order rule out nearly all triples of columns and
    decide most of the others.  Only triples that have fewer than 20 complete rows there
    are looked at again over the whole table.
    """
    names, text = _texts(df, order_by)
    if len(names) < 3:
        return []
    if whole_table:
        every = [
            (t, a, b)
            for t in range(len(names))
            for a, b in combinations([i for i in range(len(names)) if i != t], 2)
        ]
        judged = _judge(text, every, sample=False)
        derived = {t for (t, _, _), (_, both) in judged.items() if both}
        return [n for i, n in enumerate(names) if i in derived]
    found = _from_prefix(text, len(names), _leading(df, order_by))
    return found.names(names)


@dataclass
class Derived:
    """What the rows seen so far say: decided columns, and triples with fewer than 20 complete rows."""

    decided: set[int]
    #: Complete rows of each open triple; all of them contain both parts.
    open: dict[tuple[int, int, int], int]

    def names(self, texts: Sequence[str]) -> list[str]:
        """Derived columns as far as the rows go; a triple without complete rows says nothing."""
        derived = self.decided | {t for (t, _, _), n in self.open.items() if n}
        return [name for i, name in enumerate(texts) if i in derived]


def derived_state(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> Derived:
    """The same as `derived_columns` in a form that goes on with later rows."""
    names, text = _texts(df, order_by)
    return _from_prefix(text, len(names), _leading(df, order_by)) if len(names) >= 3 else Derived(set(), {})


def with_later_rows(state: Derived, df: DataFrame, order_by: Sequence[str | Column] | None = None) -> Derived:
    """The state after further rows, which come after all earlier ones."""
    open_ = {x: n for x, n in state.open.items() if x[0] not in state.decided}
    judged = _judge(_texts(df, order_by)[1], list(open_), open_)
    seen = {x: (n + judged.get(x, (0, True))[0], judged.get(x, (0, True))[1]) for x, n in open_.items()}
    decided = state.decided | {x[0] for x, (n, both) in seen.items() if both and n == SAMPLE_ROWS}
    return Derived(decided, {x: n for x, (n, both) in seen.items() if both and x[0] not in decided})


def text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def _texts(df: DataFrame, order_by: Sequence[str | Column] | None) -> tuple[list[str], DataFrame]:
    names = text_names(df)
    keys = [col(k) if isinstance(k, str) else k for k in order_by or stored_order(df)]
    return names, df.select(
        F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("position"),
        F.array(*[col(n) for n in names]).alias("texts"),
    )


def _leading(df: DataFrame, order_by: Sequence[str | Column] | None) -> Column | None:
    """A condition on ``position`` that the first rows meet and few others, from the first key alone.

    That column is read by itself, and most stored rows are then passed over by its statistics.
    """
    key = (order_by or [None])[0]
    if not isinstance(key, str) or not isinstance(df.schema[key].dataType, _COMPARED):
        return None
    first = df.select(col(key).alias("k0")).orderBy("k0").limit(PREFIX_ROWS)
    last = first.agg(F.max("k0").alias("last")).first()["last"]
    k0 = F.col("position.k0")
    return k0.isNull() if last is None else k0.isNull() | (k0 <= F.lit(last).cast(df.schema[key].dataType))


def _from_prefix(text: DataFrame, width: int, leading: Column | None = None) -> Derived:
    ahead = text if leading is None else text.where(leading)
    prefix = ahead.orderBy("position").limit(PREFIX_ROWS).persist()
    try:
        triples = _possible_triples(prefix, width)
        judged = _judge(prefix, triples)
        decided = {t for (t, _, _), (n, both) in judged.items() if both and n == SAMPLE_ROWS}
        undecided = [
            x for x in triples if judged.get(x, (0, False))[0] < SAMPLE_ROWS and x[0] not in decided
        ]
        if undecided and prefix.count() == PREFIX_ROWS:
            judged = _judge(text, undecided)
    finally:
        prefix.unpersist()
    verdicts = {x: judged.get(x, (0, True)) for x in undecided}
    decided |= {x[0] for x, (n, both) in verdicts.items() if both and n == SAMPLE_ROWS}
    return Derived(decided, {x: n for x, (n, both) in verdicts.items() if both and x[0] not in decided})


def _indices(rows: Sequence[tuple], fields: Sequence[str]) -> Column:
    """A constant array of index tuples to explode against every row."""
    text = json.dumps([dict(zip(fields, r)) for r in rows])
    return F.from_json(F.lit(text), "array<struct<" + ",".join(f"{f}:int" for f in fields) + ">>")


def _text(index: str) -> Column:
    return F.get("texts", F.col(index))


def _possible_triples(prefix: DataFrame, width: int) -> list[tuple[int, int, int]]:
    """Triples that no row of the prefix refutes.

    A row among the first 20 of a pair (target, part) that lacks the containment belongs to
    the sample of every triple whose third column is present in that row, and refutes it.
    """
    pairs = [(t, a) for t in range(width) for a in range(width) if t != a]
    first_rows = Window.partitionBy("t", "a").orderBy("position")
    present = F.filter(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("texts", i).isNotNull()
    )
    refuting = (
        prefix.select("position", "texts", F.inline(_indices(pairs, ["t", "a"])))
        .where(_text("t").isNotNull() & _text("a").isNotNull())
        .withColumn("place", F.row_number().over(first_rows))
        .where((F.col("place") <= SAMPLE_ROWS) & ~F.contains(_text("t"), _text("a")))
        .groupBy("t", "a")
        # At most 20 arrays, each no longer than the number of columns.
        .agg(F.array_distinct(F.flatten(F.collect_set(present))).alias("refuted"))
        .collect()
    )
    refuted = {(r["t"], r["a"]): set(r["refuted"]) for r in refuting}
    none: set[int] = set()
    return [
        (t, a, b)
        for t in range(width)
        for a, b in combinations([i for i in range(width) if i != t], 2)
        if b not in refuted.get((t, a), none) and a not in refuted.get((t, b), none)
    ]


def _judge(
    rows: DataFrame,
    triples: list[tuple[int, int, int]],
    seen: dict[tuple[int, int, int], int] | None = None,
    sample: bool = True,
) -> dict[tuple[int, int, int], tuple[int, bool]]:
    """Complete rows (of a sample at most 20) and verdict per triple; one result row per triple.

    A row is multiplied only by the triples that are complete in it.  ``seen`` says how many
    rows of the sample came before these.
    """
    if not triples:
        return {}
    fields = ["t", "a", "b"]
    wanted = [(*x, SAMPLE_ROWS - (seen or {}).get(x, 0)) for x in triples]
    complete = F.filter(
        _indices(wanted, [*fields, "wanted"]),
        lambda x: reduce(and_, (F.get("texts", x[f]).isNotNull() for f in fields)),
    )
    found = rows.select("position", "texts", F.inline(complete)).select(
        *fields, "wanted", "position",
        (F.contains(_text("t"), _text("a")) & F.contains(_text("t"), _text("b"))).alias("both"),
    )
    if sample:
        first_rows = Window.partitionBy(*fields).orderBy("position")
        found = found.withColumn("place", F.row_number().over(first_rows)).where(
            F.col("place") <= F.col("wanted")
        )
    verdicts = (
        found.groupBy(*fields)
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and("both").alias("contains_both"))
        .collect()
    )
    return {(r["t"], r["a"], r["b"]): (r["n"], r["contains_both"]) for r in verdicts}
