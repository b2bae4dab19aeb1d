"""How far the sources of a language differ in their words: a frequent-pattern tree of term rows.

A term's row lists its count at every source that uses it, in the order of the sources.  The
divergence of a source from another one is a sum over all terms, of which most have no count at
either.  It is taken apart:

    all terms as if both counts were 0
  + terms the one source has, as if the other had none     (a histogram of each source's counts)
  + the same the other way round
  + corrections for terms that both have

Only the last part needs term rows.  Rows enter a prefix tree with their multiplicities: rows
that begin with the same counts at the same sources share nodes, and each pair of a node and one
of its ancestors yields one correction, times the rows below the node.  Rows are dealt by
range and sorted, so a task sees its part of the tree branch by branch and holds one batch.

A row is an array of integers, three to a source: its place among the language's sources, its
p there, and p of a term without count there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from factloom.llm.common import LOWER, written

#: Fixed value: parts per billion.
SCALE = 1_000_000_000
#: Documents of a language that a term has to occur in.
LEAST_DOCUMENTS = 3
#: Terms listed for each group.
TERM_RANKS = 200
#: Distinct counts that a task gathers before it hands them on.
HELD = 1_000_000
#: Code points of text split into terms at once.
AT_ONCE = 1 << 20
#: Node and ancestor pairs worked on at once.
PAIRS_AT_ONCE = 1 << 21
#: Salts of the histogram rows of a language.
SALTS = 16

#: A-Z to lower case, the other letters as they are, everything else of ASCII to a space.
_TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in LOWER)
_COUNTS = "lang string, term string, source string, n long"
_CORRECTIONS = "lang string, a long, b long, high long, low long"


def _pieces(text: str) -> Iterator[bytes]:
    """The text in runs that end between terms."""
    if len(text) <= AT_ONCE:
        yield text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
        return
    rest = b""
    for at in range(0, len(text), AT_ONCE):
        run = rest + text[at : at + AT_ONCE].encode("utf-8", "surrogatepass").translate(_TERM_BYTES)
        cut = run.rfind(b" ") + 1
        yield run[:cut]
        rest = run[cut:]
    yield rest


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, n) of the documents of a task; source null: documents with the term."""
    occurrences: dict[tuple, Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurrences.items():
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    pa.array(list(counts), pa.binary()).cast(pa.string()),
                    pa.array([source] * n, pa.string()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                ["lang", "term", "source", "n"],
            )
        occurrences.clear()

    seen = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            distinct: set[bytes] = set()
            for run in _pieces(text):
                terms = run.split()
                occurrences[lang, source].update(terms)
                distinct.update(terms)
            occurrences[lang, None].update(distinct)
            seen += len(distinct)
            if seen > HELD:  # an upper bound; now the real number
                seen = sum(map(len, occurrences.values()))
                if seen > HELD // 2:
                    yield from flushed()
                    seen = 0
    yield from flushed()


def term_rows(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, n_docs, counts): terms in at least `least` documents of a language.

    ``counts`` holds (source, n) for every source that uses the term, by source.  `docs` has
    lang, source and text without nulls.
    """
    partial = docs.select("lang", "source", "text").mapInArrow(_counted, _COUNTS)
    return (
        # One shuffle serves both groupings; a term has at most a row per task and source here.
        partial.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang", "term")
        .agg(
            F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("n_docs"),
            F.sort_array(
                F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n")))
            ).alias("counts"),
        )
        .where(F.col("n_docs") >= least)
    )


def _share(n: Column, total: Column, terms: Column) -> Column:
    """p: parts per billion of a count, plus one; null without terms."""
    exact = "decimal(38,0)"
    size = F.nullif(total + terms, F.lit(0)).cast(exact)
    # `div` is the exact whole quotient, as `/` of decimals would round.
    return 1 + F.call_function("div", F.lit(SCALE).cast(exact) * (n + 1).cast(exact), size)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, place, n, terms, none, lang_n): one row per occurring group.

    ``place`` numbers a language's sources, ``n`` counts the group's kept terms, ``terms`` how
    many the language keeps, ``none`` is p without a count; lang_n is n of the language.
    """
    held = (
        rows.select("lang", F.explode("counts").alias("c"))
        .groupBy("lang", F.col("c.source").alias("source"))
        .agg(F.sum("c.n").alias("n"))
    )
    kept = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    by_lang = Window.partitionBy("lang")
    return (
        docs.select("lang", "source")
        .distinct()
        .join(held, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .fillna(0, ["n", "terms"])
        .withColumn("place", F.row_number().over(by_lang.orderBy("source")).cast("long"))
        .withColumn("lang_n", F.sum("n").over(by_lang))
        .withColumn("none", _share(F.lit(0), F.col("n"), F.col("terms")))
    )


def _whole_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, row, times): distinct rows with their multiplicities."""
    alike = rows.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("times"))
    items = written(alike.withColumn("id", F.monotonically_increasing_id()), "distinct-rows")
    p = _share(F.col("c.n"), F.col("n"), F.col("terms"))
    return (
        items.select("lang", "id", "times", F.explode("counts").alias("c"), F.col("c.source").alias("source"))
        .join(groups, ["lang", "source"])
        .groupBy("lang", "id", "times")
        .agg(F.flatten(F.sort_array(F.collect_list(F.array("place", p, "none")))).alias("row"))
        .drop("id")
    )


class _Tree:
    """Node and ancestor pairs of consecutive sorted rows of one language."""

    def __init__(self, rows: pa.ListArray, times: np.ndarray):
        self.items = rows.values.to_numpy().reshape(-1, 3)
        offsets = rows.offsets.to_numpy() // 3
        self.first, self.length, self.times = offsets[:-1], np.diff(offsets), times

    def combinations(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ancestors, nodes, rows below the node), ancestors and nodes as items."""
        shared = np.r_[False, np.ones(len(self.length) - 1, bool)]
        for depth in range(int(self.length.max(initial=0))):
            there = np.flatnonzero(self.length > depth)
            at = self.first[there] + depth
            before = np.maximum(there - 1, 0)
            # A row goes on along its predecessor's branch while all items so far agree.
            along = shared[there] & (self.length[before] > depth)
            earlier = np.where(along, self.first[before] + depth, 0)
            along &= (self.items[at, :2] == self.items[earlier, :2]).all(axis=1)
            shared[:] = False
            shared[there] = along
            starts = np.flatnonzero(~along)
            below = np.add.reduceat(self.times[there], starts)
            if not depth:
                continue
            step = max(1, PAIRS_AT_ONCE // depth)
            for s in range(0, len(starts), step):
                node = there[starts[s : s + step]]
                up = (self.first[node][:, None] + np.arange(depth)).ravel()
                own = np.repeat(self.first[node] + depth, depth)
                yield self.items[up], self.items[own], np.repeat(below[s : s + step], depth)


def _corrected(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What terms that both items have add to the divergence beyond the parts for one alone."""

    def f(x, y):
        return (x - y) * (x - y) // y

    return f(p[:, 1], q[:, 1]) - f(p[:, 1], q[:, 2]) - f(p[:, 2], q[:, 1]) + f(p[:, 2], q[:, 2])


def _sums(lang: str, tree: _Tree) -> Iterator[pa.RecordBatch]:
    for up, own, below in tree.combinations():
        for p, q in ((up, own), (own, up)):
            order = np.lexsort((q[:, 0], p[:, 0]))
            a, b = p[order, 0], q[order, 0]
            starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            value, times = _corrected(p, q)[order], below[order]
            # Halves of 32 bits, so that sums over all rows stay exact.
            high = np.add.reduceat((value >> 32) * times, starts)
            low = np.add.reduceat((value & 0xFFFFFFFF) * times, starts)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), *map(pa.array, (a[starts], b[starts], high, low))],
                ["lang", "a", "b", "high", "low"],
            )


def _tree_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        codes = langs.indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]) if len(codes) else []
        for from_, upto in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(from_, upto - from_)
            rows = pa.concat_arrays([part["row"]])  # offsets from zero
            yield from _sums(part["lang"][0].as_py(), _Tree(rows, part["times"].to_numpy()))


def _pair_corrections(whole: DataFrame) -> DataFrame:
    """(lang, a, b, value): the sum of corrections for every pair of sources, by places."""
    exact = "decimal(38,0)"
    return (
        whole.repartitionByRange("lang", "row")
        .sortWithinPartitions("lang", "row")
        .select("lang", "row", "times")
        .mapInArrow(_tree_sums, _CORRECTIONS)
        .groupBy("lang", "a", "b")
        .agg(F.sum(F.col("high").cast(exact)).alias("high"), F.sum(F.col("low").cast(exact)).alias("low"))
        .select("lang", "a", "b", (F.col("high") * (1 << 32) + F.col("low")).cast(exact).alias("value"))
    )


def _one_sided(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): all terms without counts, and those that one of both sources has.

    Works on the histogram of each source's counts; a language's are spread over SALTS.
    """
    exact = "decimal(38,0)"
    counts = (
        rows.select("lang", F.explode("counts").alias("c"))
        .groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("c"))
        .agg(F.count(F.lit(1)).alias("times"))
        .join(groups, ["lang", "source"])
        .select(
            "lang", F.col("place").alias("x"), F.col("none").alias("x_none"), "times",
            _share(F.col("c"), F.col("n"), F.col("terms")).alias("p"),
            F.pmod(F.xxhash64("place", "c"), F.lit(SALTS)).alias("salt"),
        )
    )
    others = groups.select(
        "lang", F.col("place").alias("y"), F.col("none").alias("y_none"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"),
    )
    none = _divergence(F.col("x_none"), F.col("y_none"))
    back = _divergence(F.col("y_none"), F.col("x_none"))
    sums = (
        counts.join(others, ["lang", "salt"])
        .where("x <> y")
        .groupBy("lang", "x", "y")
        .agg(
            F.sum(((_divergence(F.col("p"), F.col("y_none")) - none).cast(exact) * F.col("times"))).alias("to"),
            F.sum(((_divergence(F.col("y_none"), F.col("p")) - back).cast(exact) * F.col("times"))).alias("fro"),
        )
    )
    x, y = groups.select("lang", F.col("place").alias("a"), F.col("none").alias("p"), "terms"), groups.select(
        "lang", F.col("place").alias("b"), F.col("none").alias("q")
    )
    empty = F.coalesce(_divergence(F.col("p"), F.col("q")), F.lit(0)).cast(exact) * F.col("terms")
    value = lambda c: F.col(c).cast(exact).alias("value")
    return (
        x.join(y, "lang").where("a <> b").select("lang", "a", "b", empty.cast(exact).alias("value"))
        .unionByName(sums.select("lang", F.col("x").alias("a"), F.col("y").alias("b"), value("to")))
        .unionByName(sums.select("lang", F.col("y").alias("a"), F.col("x").alias("b"), value("fro")))
    )


def pair_divergence(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): divergence of every source from every other of its language."""
    parts = _one_sided(rows, groups).unionByName(_pair_corrections(_whole_rows(rows, groups)))
    names = groups.select("lang", "place", "source")
    return (
        parts.groupBy("lang", "a", "b")
        .agg(F.sum("value").cast("long").alias("value"))
        .join(names.withColumnsRenamed({"place": "a"}), ["lang", "a"])
        .join(names.withColumnsRenamed({"place": "b", "source": "item"}), ["lang", "b"])
        .select("lang", "source", "item", "value")
    )


def term_divergence(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a source uses more than its language does."""
    p = _share(F.col("c.n"), F.col("n"), F.col("terms"))
    q = _share(F.col("everywhere"), F.col("lang_n"), F.col("terms"))
    everywhere = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return (
        rows.select("lang", "term", everywhere.alias("everywhere"), F.explode("counts").alias("c"))
        .select("*", F.col("c.source").alias("source"))
        .join(groups, ["lang", "source"])
        .select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .where("p > q")
        .select("lang", "source", "item", _divergence(F.col("p"), F.col("q")).alias("value"))
    )


def source_divergence(
    docs: DataFrame,
    least: int = LEAST_DOCUMENTS,
    term_ranks: int = TERM_RANKS,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring (lang, source).

    Terms are runs of ASCII letters (A-Z lower-cased) and non-ASCII characters; a language keeps
    those in at least `least` of its documents.  Part ``pair`` ranks all other sources of the
    language by divergence, part ``term`` the `term_ranks` terms most in excess of the language.
    Values are exact integers, at most 63 bits.

    Null text, language and source count as empty texts; a group without terms still has its
    pairs, whose value is 0 where the language keeps no term.  Repeated rows are documents of
    their own.  Very long texts are read in runs of AT_ONCE.  Ties rank by item.  A table
    without rows gives none; other columns are ignored.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(
        filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text")
    )
    rows = written(term_rows(docs, least), "term-rows")
    groups = written(groups_of(docs, rows), "source-groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )
    terms = ranked(term_divergence(rows, groups), "term").where(F.col("rank") <= term_ranks)
    return ranked(pair_divergence(rows, groups), "pair").unionByName(terms)
