"""Knowledge tables: Parquet folders, switched by one small manifest per dataset.

A build writes each table below a version of its own, ``table/dataset_id=../version=../``, and
ends with one file, the next numbered manifest, which says what versions make up the dataset's
knowledge and is created only if that number is still free.  Until then readers see the earlier
knowledge, from then on the new one; nothing they can see is deleted, moved or renamed.
A `Snapshot` reads one manifest's tables however many builds follow.  `vacuum` removes what
no recent manifest names.

Append-only tables (registry, answers) have a folder per write instead.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from factloom.schemas import SCHEMAS
from factloom.sources.tables import remove

_REGISTRY_LINE = (
    "name string, source_path string, format string, size_bytes bigint, row_count bigint,"
    " column_count int, status string"
)


class DatasetNotFound(LookupError):
    """No dataset with this id is registered."""


class DatasetNotReady(RuntimeError):
    """The dataset is registered but its knowledge is not complete."""


class CommitConflict(RuntimeError):
    """Another writer has committed this dataset since the draft was begun."""


#: Append-only tables; all others belong to a manifest.
LOGS = ("datasets", "arrival_attempts", "rejected_questions", "analyst_queries")
#: A manifest that stays incomplete for so long was left by a writer that died.
TORN_SECONDS = 60.0


@dataclass
class Manifest:
    """What makes up the knowledge of a dataset: versions per table, oldest first."""

    number: int
    tables: dict[str, list[str]] = field(default_factory=dict)
    #: (path, format) of the files that were read, in the order they were added.
    sources: list[list[str]] = field(default_factory=list)
    #: What a later append has to know besides the tables.
    notes: dict = field(default_factory=dict)


class Snapshot:
    """The knowledge of a dataset as one manifest has it."""

    def __init__(self, store: KnowledgeStore, dataset_id: str, manifest: Manifest):
        self.store, self.dataset_id, self.manifest = store, dataset_id, manifest

    def read(self, table: str) -> DataFrame:
        return self.store._scan(table, self.store._version_folders(self.dataset_id, self.manifest, table))


class Draft:
    """Tables of a dataset on their way to the next manifest."""

    def __init__(self, store: KnowledgeStore, dataset_id: str, base: Snapshot | None):
        self.store, self.dataset_id, self.base = store, dataset_id, base
        before = base.manifest if base else Manifest(0)
        self.manifest = Manifest(before.number, {}, list(before.sources), dict(before.notes))
        self._written: list[str] = []

    def write(self, table: str, rows: DataFrame, split_by: str | None = None) -> None:
        """The dataset's rows of a table; ``split_by`` adds a folder level."""
        if split_by:
            # Rebalancing gathers small files and splits a value that outgrows the rest.
            rows = rows.hint("rebalance", split_by)
        writer = rows.write.partitionBy(split_by) if split_by else rows.write
        self.manifest.tables[table] = [self._stored(table, writer)]

    def add(self, table: str, rows: DataFrame) -> None:
        """Further rows of a table next to those of the base."""
        self.manifest.tables[table] = [*self.kept(table), self._stored(table, rows.write)]

    def keep(self, table: str) -> None:
        """Take the table over from the base as it is."""
        self.manifest.tables[table] = self.kept(table)

    def kept(self, table: str) -> list[str]:
        """The base's versions of a table."""
        return list(self.base.manifest.tables.get(table, [])) if self.base else []

    def _stored(self, table: str, writer: DataFrameWriter) -> str:
        version = "v" + uuid.uuid4().hex
        folder = f"{self.store._folder(table, self.dataset_id)}/version={version}"
        self._written.append(folder)
        writer.parquet(folder)
        return version

    def read(self, table: str) -> DataFrame:
        """What readers of the table will get."""
        return self.store._scan(table, self.store._version_folders(self.dataset_id, self.manifest, table))

    def commit(self) -> Snapshot:
        """Make the draft the dataset's knowledge.

        With a base that is no longer the latest this fails; without one the last writer wins.
        """
        while True:
            try:
                self.manifest.number = self.store._next_number(self.dataset_id, self.base)
                self.store._create_manifest(self.dataset_id, self.manifest)
                return Snapshot(self.store, self.dataset_id, self.manifest)
            except CommitConflict:
                if self.base:
                    raise
                time.sleep(0.2)

    def discard(self) -> None:
        """Remove what was written; for drafts that are not committed."""
        for folder in self._written:
            remove(self.store.spark, folder)


class KnowledgeStore:
    """Read and write access to the knowledge tables below one shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folder(self, table: str, dataset_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", dataset_id):
            raise ValueError(f"not a usable dataset id: {dataset_id!r}")
        return f"{self.root}/{table}/dataset_id={dataset_id}"

    # -- versions and manifests -------------------------------------------------------

    def snapshot(self, dataset_id: str) -> Snapshot | None:
        """The knowledge of a dataset as it is now; None before the first build."""
        for number in reversed(self._numbers(dataset_id)):
            manifest = self._read_manifest(dataset_id, number)
            if manifest:
                return Snapshot(self, dataset_id, manifest)
        return None

    def draft(self, dataset_id: str, base: Snapshot | None = None) -> Draft:
        """A new version; with a base, the commit fails if that is no longer the latest."""
        return Draft(self, dataset_id, base)

    def replace(self, table: str, dataset_id: str, rows: DataFrame, split_by: str | None = None) -> None:
        """Replace the dataset's rows of one table; the others stay."""
        base = self.snapshot(dataset_id)
        draft = self.draft(dataset_id, base)
        for other in base.manifest.tables if base else ():
            draft.keep(other)
        draft.write(table, rows, split_by)
        draft.commit()

    def vacuum(self, dataset_id: str, keep: int = 1, older_than: float = 24 * 3600.0) -> int:
        """Remove manifests but the last ``keep``, and versions that none of them names.

        Only what was written more than ``older_than`` seconds ago goes, so that running
        builds and readers of recent snapshots are left alone.  Returns the folders removed,
        copies of rows that nothing refers to included.
        """
        numbers = self._numbers(dataset_id)
        whole = {n: m for n in numbers if (m := self._read_manifest(dataset_id, n))}
        latest = sorted(whole)[-keep:]
        named = {(t, v) for n in latest for t, vs in whole[n].tables.items() for v in vs}
        horizon = (time.time() - older_than) * 1000
        removed = 0
        for table in (t for t in SCHEMAS if t not in LOGS):
            for status in self._listed(self._folder(table, dataset_id)):
                name = status.getPath().getName()
                if (table, name.removeprefix("version=")) not in named and status.getModificationTime() < horizon:
                    remove(self.spark, status.getPath().toString())
                    removed += 1
        read = {path for n in latest for path, _ in whole[n].sources}
        current = self._current(dataset_id)
        read |= {current["source_path"]} if current else set()
        for status in self._listed(self.copies(dataset_id)):
            name = status.getPath().getName()
            in_use = {f"{self.copies(dataset_id)}/{name}"} & {*read, *map(partial(self.copy_of, dataset_id), read)}
            if not in_use and status.getModificationTime() < horizon:
                remove(self.spark, status.getPath().toString())
                removed += 1
        for status in self._listed(self._manifests(dataset_id)):
            number = _number_of(status.getPath().getName())
            if latest and number is not None and number < latest[0] and status.getModificationTime() < horizon:
                remove(self.spark, status.getPath().toString())
        return removed

    def copies(self, dataset_id: str) -> str:
        """Where copies of a dataset's rows are kept."""
        self._folder("sources", dataset_id)
        return f"{self.root}/sources/{dataset_id}"

    def copy_of(self, dataset_id: str, path: str) -> str:
        """The place of the parsed copy of a text file."""
        return f"{self.copies(dataset_id)}/{hashlib.sha256(path.encode()).hexdigest()[:24]}"

    def _manifests(self, dataset_id: str) -> str:
        return self._folder("manifests", dataset_id)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list:
        path, files = self._path(folder)
        try:
            return list(files.listStatus(path))
        except Py4JJavaError as error:
            if "FileNotFoundException" in str(error.java_exception.getClass().getName()):
                return []
            raise

    def _numbers(self, dataset_id: str) -> list[int]:
        names = (s.getPath().getName() for s in self._listed(self._manifests(dataset_id)))
        return sorted(n for n in map(_number_of, names) if n is not None)

    def _manifest_file(self, dataset_id: str, number: int) -> str:
        return f"{self._manifests(dataset_id)}/{number:012d}.json"

    def _read_manifest(self, dataset_id: str, number: int) -> Manifest | None:
        """The manifest; None if it is gone or its writer has not come to the end of it."""
        path, files = self._path(self._manifest_file(dataset_id, number))
        try:
            stream = files.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            return Manifest(**json.loads(text))
        except (Py4JJavaError, ValueError, TypeError):
            return None

    def _next_number(self, dataset_id: str, base: Snapshot | None) -> int:
        latest = self.snapshot(dataset_id)
        if base and (latest is None or latest.manifest.number != base.manifest.number):
            raise CommitConflict(f"{dataset_id} has changed since version {base.manifest.number}")
        last = max(self._numbers(dataset_id), default=0)
        if last > (latest.manifest.number if latest else 0):
            path, files = self._path(self._manifest_file(dataset_id, last))
            if time.time() * 1000 - files.getFileStatus(path).getModificationTime() < TORN_SECONDS * 1000:
                raise CommitConflict(f"another writer is committing {dataset_id}")
        return last + 1

    def _create_manifest(self, dataset_id: str, manifest: Manifest) -> None:
        """The switch: one file that is created only if nobody has created it before."""
        path, files = self._path(self._manifest_file(dataset_id, manifest.number))
        try:
            stream = files.create(path, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                raise CommitConflict(f"{dataset_id} was committed by another writer") from error
            raise
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()

    def _version_folders(self, dataset_id: str, manifest: Manifest, table: str) -> list[str]:
        top = self._folder(table, dataset_id)
        return [f"{top}/version={v}" for v in manifest.tables.get(table, [])]

    def _scan(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self.spark.read.schema(SCHEMAS[table]).option("basePath", f"{self.root}/{table}").parquet(*folders)
        return rows.select(*T.StructType.fromDDL(SCHEMAS[table]).names)

    # -- tables -----------------------------------------------------------------------

    def append(self, table: str, dataset_id: str, rows: DataFrame, part: str, part_id: str) -> None:
        """Add rows to a log under their own part; writing the same part again replaces it."""
        rows.write.mode("overwrite").parquet(f"{self._folder(table, dataset_id)}/{part}={part_id}")

    def read(self, table: str, dataset_id: str | None = None) -> DataFrame:
        """Rows of a table, or of one dataset in it, as of now."""
        if table in LOGS:
            return self._read_log(table, dataset_id)
        if dataset_id is not None:
            found = [self.snapshot(dataset_id)]
        else:
            listed = (s.getPath().getName() for s in self._listed(f"{self.root}/manifests"))
            found = [self.snapshot(n.removeprefix("dataset_id=")) for n in listed if n.startswith("dataset_id=")]
        folders = [f for s in found if s for f in self._version_folders(s.dataset_id, s.manifest, table)]
        return self._scan(table, folders)

    def _read_log(self, table: str, dataset_id: str | None) -> DataFrame:
        top = f"{self.root}/{table}"
        try:
            return (
                self.spark.read.schema(SCHEMAS[table])
                .option("basePath", top)
                .parquet(top if dataset_id is None else self._folder(table, dataset_id))
            )
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    # -- dataset registry -------------------------------------------------------------

    def log_status(self, dataset_id: str, status: str, **known) -> None:
        """Append one line to the history of a dataset; fields left out keep their value."""
        fields = T.StructType.fromDDL(_REGISTRY_LINE)
        row = tuple({**known, "status": status}.get(f) for f in fields.names)
        line = self.spark.createDataFrame([row], fields).withColumn(
            "updated_at", F.current_timestamp()
        )
        self.append("datasets", dataset_id, line.coalesce(1), "event", uuid.uuid4().hex)

    def log_many(self, lines: Sequence[dict]) -> None:
        """Append a line each to the histories of many datasets, each in a folder of its own."""
        for line in lines:
            self._folder("datasets", line["dataset_id"])
        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(lambda line: self.log_status(**line), lines))

    def log_rows(self, table: str, rows: Sequence[tuple], fields: str) -> None:
        """Append rows of any datasets to a log, in one write with a folder of its own."""
        lines = self.spark.createDataFrame(rows, fields).withColumn("at", F.current_timestamp())
        lines.coalesce(1).write.parquet(f"{self.root}/{table}/event={uuid.uuid4().hex}")

    def readiness(self, asked: DataFrame) -> DataFrame:
        """For each row with a dataset_id whether that can be asked: ready, not ready, or unknown."""
        known = self.datasets().select("dataset_id", "status")
        return asked.join(known, "dataset_id", "left").withColumn(
            "readiness",
            F.when(F.col("status").isNull(), "unknown")
            .when(F.col("status") == "processed", "ready")
            .otherwise("not ready"),
        )

    def datasets(self) -> DataFrame:
        """Every dataset with the last known value of each field."""
        return self._latest(self.read("datasets"))

    @staticmethod
    def _latest(history: DataFrame) -> DataFrame:
        moment = F.struct("updated_at", "event")
        return history.groupBy("dataset_id").agg(
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), moment)).alias(c)
                for c in T.StructType.fromDDL(_REGISTRY_LINE).names
            ],
            F.min("updated_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )

    def _current(self, dataset_id: str):
        return self._latest(self.read("datasets", dataset_id)).first()

    def require(self, dataset_id: str, processed: bool = True):
        """The registry row of a dataset, which must exist and (by default) be ready."""
        row = self._current(dataset_id)
        if row is None:
            raise DatasetNotFound(dataset_id)
        if processed and row["status"] != "processed":
            raise DatasetNotReady(f"{dataset_id} has status {row['status']}")
        return row

    # -- read operators ---------------------------------------------------------------

    def schema_report(self, dataset_id: str) -> DataFrame:
        """Column metadata with statistics, in column order, of one snapshot."""
        self.require(dataset_id, processed=False)
        pinned = self.snapshot(dataset_id) or Snapshot(self, dataset_id, Manifest(0))
        stats = pinned.read("column_stats").drop("dataset_id", "name", "unique_count")
        return (
            pinned.read("column_metadata")
            .join(stats, "ordinal", "left")
            .orderBy("ordinal")
        )


def _number_of(name: str) -> int | None:
    found = re.fullmatch(r"(\d+)\.json", name)
    return int(found[1]) if found else None
