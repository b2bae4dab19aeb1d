"""The user-facing surface: register datasets, read their knowledge, ask questions."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factloom.operators import cube, impact, questions, relationships, retrieval
from factloom.operators.derived import stored_order
from factloom.plans.pipeline import append_knowledge, build_knowledge, stored_roles
from factloom.sources.store import KnowledgeStore, Manifest, Snapshot
from factloom.sources.tables import materialise, read_table, remove

#: Column of stored copies that holds where a row stood in its source.
PLACE = "__place"
#: Row groups of stored copies; a task reads at least one.
ROW_GROUP_BYTES = 8 << 20


class Workspace:
    """Datasets and their knowledge below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = KnowledgeStore(spark, root)

    # -- datasets ---------------------------------------------------------------------

    def register(
        self,
        source_path: str,
        fmt: str = "parquet",
        name: str | None = None,
        dataset_id: str | None = None,
        size_bytes: int | None = None,
    ) -> str:
        """Enter a stored dataset with status ``processing`` and return its id."""
        return self.register_all([(source_path, fmt, name, dataset_id, size_bytes)])[0]

    def register_all(self, sources: Sequence[tuple]) -> list[str]:
        """Enter many datasets, given as (path, format, name, id, size), in one write."""
        lines = []
        for source_path, fmt, name, dataset_id, size_bytes in sources:
            stem = source_path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
            lines.append(
                {
                    "dataset_id": dataset_id or str(uuid.uuid4()),
                    "status": "processing",
                    "name": name or stem,
                    "source_path": source_path,
                    "format": fmt,
                    "size_bytes": size_bytes,
                    "row_count": 0,
                    "column_count": 0,
                }
            )
        self.store.log_many(lines)
        return [line["dataset_id"] for line in lines]

    def add(self, df: DataFrame, name: str, dataset_id: str | None = None) -> str:
        """Write a DataFrame below the workspace and register it.

        The knowledge build scans its input several times; a written copy keeps an
        expensive plan from being run again and survives lost executors.
        """
        dataset_id = dataset_id or str(uuid.uuid4())
        return self.register(self._written(dataset_id, df), "parquet", name, dataset_id)

    def process(
        self, dataset_id: str, order_by: Sequence[str | Column] | None = None, keep_appended: bool = True
    ) -> None:
        """Build all knowledge of a registered dataset, with or without what has been appended since."""
        entry = self.store.require(dataset_id, processed=False)
        try:
            sources = self._sources(dataset_id, entry)[: None if keep_appended else 1]
            first, order, hidden = self._opened(dataset_id, *sources[0])
            later = [df.drop(*h) for df, _, h in (self._opened(dataset_id, *s) for s in sources[1:])]
        except Exception:
            self.store.log_status(dataset_id, "error")
            raise
        build_knowledge(self.store, dataset_id, first, order_by or order, hidden, sources, later)

    def append(self, dataset_id: str, rows: str | DataFrame, fmt: str = "parquet") -> bool:
        """Add rows, given as a path or a DataFrame, to a processed dataset.

        Only the new rows are read; the knowledge is that of a rebuild over all rows, in which
        they come last.  Their columns must be those of the dataset.  A path that has been
        added already is left out, so repeating an append does no harm; False says so.
        """
        self.store.require(dataset_id)
        base = self.store.snapshot(dataset_id)
        if isinstance(rows, DataFrame):
            rows, fmt = self._written(dataset_id, rows), "parquet"
        source = (rows, fmt)
        if list(source) in base.manifest.sources:
            notes = base.manifest.notes
            self.store.log_status(
                dataset_id, "processed", row_count=notes["row_count"], column_count=notes["column_count"]
            )
            return False
        new, order, hidden = self._opened(dataset_id, *source)
        known = [tuple(s) for s in base.manifest.sources]

        def everything() -> DataFrame:
            parts = [self._opened(dataset_id, *s) for s in [*known, source]]
            return reduce(DataFrame.unionByName, [df.drop(*h) for df, _, h in parts])

        append_knowledge(self.store, dataset_id, base, new, everything, order, hidden, [source])
        return True

    def _sources(self, dataset_id: str, entry) -> list[tuple[str, str]]:
        """What the dataset is read from: the registered path, and what was appended to it."""
        first = (entry["source_path"], entry["format"])
        snapshot = self.store.snapshot(dataset_id)
        known = [tuple(s) for s in snapshot.manifest.sources] if snapshot else []
        return known if known[:1] == [first] else [first]

    def _opened(self, dataset_id: str, path: str, fmt: str) -> tuple[DataFrame, list[str] | None, list[str]]:
        """Rows of one source, the columns that order them, and those that are none of the data.

        A text file is parsed once; everything after reads the columns it needs from Parquet.
        The place of each row is kept next to it, because it decides about derived columns.
        """
        if fmt == "parquet":
            return read_table(self.spark, path), None, []
        copy = self.store.copy_of(dataset_id, path)
        df = read_table(self.spark, path, fmt)
        place = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(stored_order(df))])
        df.withColumn(PLACE, place).hint("rebalance").write.mode("overwrite").parquet(copy)
        return self.spark.read.parquet(copy), [PLACE], [PLACE]

    def _written(self, dataset_id: str, df: DataFrame) -> str:
        """A copy of the rows in their order, with row groups small enough to be read in parallel."""
        path = f"{self.store.copies(dataset_id)}/{uuid.uuid4().hex}"
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
        return path

    def rows(self, dataset_id: str) -> DataFrame:
        """The dataset as the knowledge build reads it."""
        entry = self.store.require(dataset_id, processed=False)
        parts = []
        for path, fmt in self._sources(dataset_id, entry):
            copy = path if fmt == "parquet" else self.store.copy_of(dataset_id, path)
            parts.append(self.spark.read.parquet(copy).drop(PLACE))
        return reduce(DataFrame.unionByName, parts)

    def datasets(self) -> DataFrame:
        return self.store.datasets()

    def schema(self, dataset_id: str) -> DataFrame:
        return self.store.schema_report(dataset_id)

    # -- analytics --------------------------------------------------------------------

    def snapshot(self, dataset_id: str) -> Snapshot:
        """The dataset's knowledge as it is now; reads that are given it are not touched by later builds."""
        return self.store.snapshot(dataset_id) or Snapshot(self.store, dataset_id, Manifest(0))

    def facts(
        self, dataset_id: str, dimension: str | None = None, limit: int = 100, at: Snapshot | None = None
    ) -> DataFrame:
        self.store.require(dataset_id, processed=False)
        at = at or self.snapshot(dataset_id)
        return cube.list_facts(at.read("fact_combinations"), dimension, limit)

    def relationships(
        self, dataset_id: str, minimum_strength: float = 0.0, at: Snapshot | None = None
    ) -> DataFrame:
        self.store.require(dataset_id, processed=False)
        at = at or self.snapshot(dataset_id)
        return relationships.list_relationships(at.read("pairwise_evidence"), minimum_strength)

    def group_means(self, dataset_id: str, dimension: str, metric: str, at: Snapshot | None = None) -> DataFrame:
        """Mean per group behind one relationship, as rows."""
        return (
            self.all_group_means(dataset_id, at)
            .where((F.col("dimension") == dimension) & (F.col("metric") == metric))
            .drop("count")
        )

    def all_group_means(self, dataset_id: str, at: Snapshot | None = None) -> DataFrame:
        """Mean per group behind every relationship of a dimension and a measure, as rows."""
        self.store.require(dataset_id, processed=False)
        at = at or self.snapshot(dataset_id)
        groups = relationships.group_stats(at.read("group_statistics"))
        return groups.select("dimension", "metric", "value", "mean", "count")

    def evidence(
        self, dataset_id: str, metric: str, dimension: str, limit: int = 20, at: Snapshot | None = None
    ) -> DataFrame:
        self.store.require(dataset_id)
        at = at or self.snapshot(dataset_id)
        return impact.ranked_evidence(
            lambda: self.rows(dataset_id),
            stored_roles(at),
            at.read("fact_combinations"),
            metric,
            dimension,
            limit,
        )

    # -- questions --------------------------------------------------------------------

    def structure(self, dataset_id: str, asked: DataFrame, at: Snapshot | None = None) -> DataFrame:
        """Structures of many questions (columns question_id, query_text)."""
        self.store.require(dataset_id)
        at = at or self.snapshot(dataset_id)
        return questions.structure_questions(asked, stored_roles(at), at.read("fact_combinations"))

    def rejected(self, asked: DataFrame) -> DataFrame:
        """Questions that `structure`, `answer` and `ask` leave out: without text, too short, too long."""
        return questions.rejected(asked)

    def answer(self, dataset_id: str, asked: DataFrame) -> DataFrame:
        """Structure and evidence package of many questions.

        The structures are used three times and therefore written below the workspace; they
        stay there for as long as the result may be read.
        """
        return self._answer(dataset_id, asked, f"{self.store.root}/scratch")

    def _answer(self, dataset_id: str, asked: DataFrame, scratch: str, at: Snapshot | None = None) -> DataFrame:
        at = at or self.snapshot(dataset_id)
        return retrieval.evidence_packages(
            materialise(self.structure(dataset_id, asked, at), "structures", scratch),
            at.read("fact_combinations"),
            at.read("pairwise_evidence"),
        )

    def ask(self, dataset_id: str, asked: DataFrame, batch: str | None = None) -> DataFrame:
        """Answer questions, keep the answers, and return them as stored.

        Repeating a batch replaces its answers.  Questions that are not answered are kept in
        the table ``rejected_questions`` of the same batch.
        """
        batch = batch or uuid.uuid4().hex
        scratch = f"{self.store.root}/scratch/{uuid.uuid4().hex}"
        refused = self.rejected(asked).select(
            F.col("question_id").cast("string"), "query_text", F.current_timestamp().alias("created_at")
        )
        self.store.append("rejected_questions", dataset_id, refused, "batch", batch)
        answers = self._answer(dataset_id, asked, scratch).select(
            F.col("question_id").cast("string"),
            "query_text",
            "structure",
            "evidence_package",
            F.current_timestamp().alias("created_at"),
        )
        self.store.append("analyst_queries", dataset_id, answers, "batch", batch)
        remove(self.spark, scratch)
        return self.store.read("analyst_queries", dataset_id).where(F.col("batch") == batch)
