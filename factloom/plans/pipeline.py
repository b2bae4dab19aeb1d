"""From one flat dataset to its stored knowledge, at once or file by file.

A build reads the rows for four things only: the first rows (derived columns), value counts,
the cube, and the sums of all pairs of measures.  All of them can be merged with those of later
rows, so they are stored next to the knowledge that is derived from them, and `append_knowledge`
reads nothing but the new rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from factloom.operators import catalog, cube, derived, profile, relationships
from factloom.operators.retrieval import relationship_id
from factloom.schemas import SCHEMAS
from factloom.sources.store import Draft, KnowledgeStore, Snapshot


class NeedsRebuild(Exception):
    """New rows change the roles of columns, so that earlier rows have to be grouped anew."""


def build_knowledge(
    store: KnowledgeStore,
    dataset_id: str,
    df: DataFrame,
    order_by: Sequence[str | Column] | None = None,
    hidden: Sequence[str] = (),
    sources: Sequence[tuple[str, str]] = (),
    later: Sequence[DataFrame] = (),
) -> Snapshot:
    """Catalog, profile, relationships and facts of a dataset, replaced as a whole.

    The new knowledge is written next to the earlier one and takes its place with one manifest,
    so readers see all of one or all of the other, also if the build is killed at any point.
    ``hidden`` columns only serve ``order_by``; ``later`` holds rows that were appended since;
    ``sources`` are noted for later appends.

    ``df`` is scanned four times with only the columns each step needs, so it should be a plain
    scan of stored files.  ``order_by`` is a total order that defines the first rows for the
    detection of derived columns; without it the stored order does.  A failure leaves the status
    ``error`` and is raised.
    """

    def fill(draft: Draft) -> tuple[int, int]:
        state = derived.derived_state(df.drop(*_unused(hidden, order_by)), order_by)
        for part in later:
            state = derived.with_later_rows(state, part)
        rows = reduce(DataFrame.unionByName, later, df.drop(*hidden))
        return _build(draft, rows, state)

    return _committed(store, dataset_id, None, fill, sources)


def append_knowledge(
    store: KnowledgeStore,
    dataset_id: str,
    base: Snapshot,
    new: DataFrame,
    everything: Callable[[], DataFrame],
    order_by: Sequence[str | Column] | None = None,
    hidden: Sequence[str] = (),
    sources: Sequence[tuple[str, str]] = (),
) -> Snapshot:
    """The knowledge of the dataset with further rows, which come after all earlier ones.

    Equal to a rebuild over all rows, but only ``new`` is read.  Where new rows make a column a
    dimension or measure that it was not, earlier rows have to be grouped anew: then, and only
    then, ``everything`` is called for all rows.  Another commit since ``base`` is a conflict,
    which leaves that one standing; a failure leaves the dataset as it was.
    """
    state = derived.with_later_rows(_stored_derived(base), new, order_by)

    def fill(draft: Draft) -> tuple[int, int]:
        return _extend(draft, new.drop(*hidden), state)

    def fill_anew(draft: Draft) -> tuple[int, int]:
        return _build(draft, everything(), state)

    noted = [*base.manifest.sources, *sources]
    try:
        return _committed(store, dataset_id, base, fill, noted)
    except NeedsRebuild:
        return _committed(store, dataset_id, base, fill_anew, noted)


def _unused(hidden, order_by) -> list[str]:
    return [h for h in hidden if h not in (order_by or ())]


def _committed(store: KnowledgeStore, dataset_id: str, base: Snapshot | None, fill, sources) -> Snapshot:
    draft = store.draft(dataset_id, base)
    draft.manifest.sources = [list(s) for s in sources]
    try:
        row_count, column_count = fill(draft)
        draft.manifest.notes |= {"row_count": row_count, "column_count": column_count}
        snapshot = draft.commit()
    except Exception:
        draft.discard()
        if base is None:
            store.log_status(dataset_id, "error")
        raise
    store.log_status(dataset_id, "processed", row_count=row_count, column_count=column_count)
    return snapshot


def _build(draft: Draft, df: DataFrame, state: derived.Derived) -> tuple[int, int]:
    draft.write("value_counts", catalog.stored_counts(catalog.value_counts(df)))
    counts = draft.read("value_counts").drop("dataset_id")
    roles = _store_catalog(draft, counts, df, state)
    texts = _long_columns(roles)
    if texts:
        draft.write("long_texts", profile.long_texts(df, texts))
    measures = catalog.measure_names(roles, with_rates=True)
    ordinals = {r.name: r.ordinal for r in roles}

    # Profile and cube need nothing from each other, nor do evidence and facts; their jobs
    # share the cluster.
    with ThreadPoolExecutor(max_workers=3) as pool:
        profiled = pool.submit(_store_profile, draft, counts, roles)
        grouped = pool.submit(
            draft.write, "group_statistics", cube.cube(df, catalog.dimension_names(roles), measures)
        )
        shifts = catalog.finite_means(counts, {m: ordinals[m] for m in measures})
        _store_pairs(draft, relationships.pair_sums(df, shifts), shifts)
        grouped.result()
        _store_conclusions(draft, roles, pool)
        profiled.result()
    return _row_count(roles), len(df.columns)


def _extend(draft: Draft, new: DataFrame, state: derived.Derived) -> tuple[int, int]:
    base = draft.base
    before = stored_roles(base)
    layout = [(r.name, r.technical_type) for r in before]
    if [(f.name, f.dataType.simpleString()) for f in new.schema.fields] != layout:
        raise ValueError(f"the new rows of {draft.dataset_id} have other columns than {layout}")

    # What is merged below is as large as the distinct values and groups, not as the rows.
    earlier = {t: base.read(t).drop("dataset_id") for t in ("value_counts", "group_statistics", "pair_sums")}
    draft.write("value_counts", catalog.stored_counts(catalog.value_counts(new, earlier["value_counts"])))
    counts = draft.read("value_counts").drop("dataset_id")
    roles = _store_catalog(draft, counts, new, state)
    dimensions, measures = catalog.dimension_names(roles), catalog.measure_names(roles, with_rates=True)
    texts = _long_columns(roles)
    _require(dimensions, catalog.dimension_names(before))
    _require(measures, catalog.measure_names(before, with_rates=True))
    _require(texts, [r.name for r in before if r.business_type == "CATEGORICAL"])
    draft.keep("long_texts")
    if texts:
        draft.add("long_texts", profile.long_texts(new, texts))

    with ThreadPoolExecutor(max_workers=3) as pool:
        profiled = pool.submit(_store_profile, draft, counts, roles)
        groups = earlier["group_statistics"].where(
            F.col("dimension").isin(dimensions) & F.col("metric").isin(measures)
        )
        grouped = pool.submit(
            draft.write, "group_statistics", cube.merged_cubes(groups, cube.cube(new, dimensions, measures))
        )
        shifts = {m: base.manifest.notes["shifts"][m] for m in measures}
        pairs = earlier["pair_sums"].where(F.col("column_a").isin(measures) & F.col("column_b").isin(measures))
        _store_pairs(draft, relationships.merged_pairs(pairs, relationships.pair_sums(new, shifts)), shifts)
        grouped.result()
        _store_conclusions(draft, roles, pool)
        profiled.result()
    return _row_count(roles), len(new.columns)


def _require(wanted: Sequence[str], known: Sequence[str]) -> None:
    if not set(wanted) <= set(known):
        raise NeedsRebuild(sorted(set(wanted) - set(known)))


def _store_catalog(draft: Draft, counts: DataFrame, df: DataFrame, state: derived.Derived) -> list[catalog.ColumnRole]:
    names = state.names(derived.text_names(df))
    described = catalog.semantic_roles(catalog.catalog_of_counts(counts, df.schema), names)
    draft.write(
        "column_metadata",
        described.withColumn("python_type", F.col("technical_type"))
        .select(*_fields("column_metadata"))
        .repartition(1),
    )
    open_ = [(*x, n) for x, n in state.open.items()]
    draft.write("open_triples", draft.store.spark.createDataFrame(open_, "t int, a int, b int, n int").coalesce(1))
    draft.manifest.notes["derived"] = sorted(state.decided)
    return stored_roles(draft)


def _stored_derived(base: Snapshot) -> derived.Derived:
    rows = base.read("open_triples").drop("dataset_id").collect()
    return derived.Derived(set(base.manifest.notes["derived"]), {(r["t"], r["a"], r["b"]): r["n"] for r in rows})


def _store_profile(draft: Draft, counts: DataFrame, roles) -> None:
    texts = draft.read("long_texts").drop("dataset_id") if _long_columns(roles) else None
    draft.write("column_stats", profile.profile_of_counts(counts, roles, texts).repartition(1))


def _store_pairs(draft: Draft, sums: DataFrame, shifts: dict[str, float]) -> None:
    draft.write("pair_sums", sums.repartition(1))
    draft.manifest.notes["shifts"] = shifts


def _store_conclusions(draft: Draft, roles, pool: ThreadPoolExecutor) -> None:
    """Evidence and facts from the written cube and sums."""
    grouped = draft.read("group_statistics").drop("dataset_id")
    related = pool.submit(_store_evidence, draft, grouped)
    _store_facts(draft, grouped, roles)
    related.result()


def _store_evidence(draft: Draft, grouped: DataFrame) -> None:
    evidence = relationships.evidence_of_states(grouped, draft.read("pair_sums"))
    evidence = evidence.withColumn("relationship_id", relationship_id(draft.dataset_id))
    draft.write("pairwise_evidence", evidence.repartition(1))


def _store_facts(draft: Draft, grouped: DataFrame, roles) -> None:
    dimensions = set(catalog.dimension_names(roles))
    usable = [r.name for r in roles if r.business_role == "MEASURE" and r.non_null_count]
    null_text = any(r.has_null_text for r in roles if r.name in dimensions)
    facts = cube.with_fact_hash(cube.facts_from_cube(grouped, usable, merge_null_text=null_text))
    draft.write("fact_combinations", facts, split_by="dimension")


def _long_columns(roles) -> list[str]:
    return [r.name for r in roles if r.business_type == "CATEGORICAL" and r.has_long_text]


def _row_count(roles) -> int:
    return max((r.row_count or 0 for r in roles), default=0)


def _fields(table: str) -> list[str]:
    return [c for c in T.StructType.fromDDL(SCHEMAS[table]).names if c != "dataset_id"]


def stored_roles(snapshot: Snapshot | Draft) -> list[catalog.ColumnRole]:
    return catalog.collect_roles(snapshot.read("column_metadata"))
