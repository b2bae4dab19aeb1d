"""Datasets are processed as they arrive.

Arrivals are announced by small JSON lines ``{"dataset_id", "path", "format", "name", "mode"}`` in
an inbox folder; the data themselves stay where they are and are read in parallel.  A line
with the mode ``append`` adds its rows to a processed dataset, any other one replaces it.

No dataset can stop the stream.  An attempt is written down before it is made, so one that takes
the driver with it counts as well; after a bounded number the dataset ends as ``error`` and its
lines are the dead letters of `dead_letters`.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.plans.workspace import Workspace

log = logging.getLogger(__name__)

ANNOUNCEMENT = "dataset_id string, path string, format string, name string, mode string"
#: What is wrong with a dataset itself, so that another attempt says the same.
DATASET_FAULTS = (AnalysisException, ValueError, LookupError)
_ATTEMPT = "dataset_id string, announced string, attempt int, outcome string, message string"


@dataclass
class Arrival:
    """What a batch has to do for one dataset."""

    dataset_id: str
    #: Identifies the announcement: its last file, and the place in it.
    announced: str
    lines: list[Row]
    attempts: int = 0


def watch_inbox(
    workspace: Workspace,
    inbox: str,
    checkpoint: str,
    available_now: bool = True,
    files_per_batch: int = 16,
    builds_at_once: int = 4,
    max_attempts: int = 3,
    pause: float = 1.0,
) -> StreamingQuery:
    """Register and process every announced dataset, several builds at a time.

    Lines count in the order of their files' time, path, and place; a replacing line makes the
    earlier ones of its dataset in the batch void.  A dataset that cannot be processed gets the
    status ``error``: at once if the fault is in what was announced (a missing path, wrong
    columns), after ``max_attempts`` otherwise (a corrupt file, lost executors).  Attempts
    outlive restarts: a repeated batch leaves out what it had finished and goes on counting.
    After the first round datasets are tried one by one, so that none is charged for another.
    """
    store = workspace.store

    def carry_out(arrival: Arrival) -> None:
        for line in arrival.lines:
            fmt = line["format"] or "parquet"
            if line["mode"] == "append":
                workspace.append(arrival.dataset_id, line["path"], fmt)
            else:
                workspace.register_all([(line["path"], fmt, line["name"], arrival.dataset_id, None)])
                workspace.process(arrival.dataset_id, keep_appended=False)

    def tried(arrival: Arrival) -> Exception | None:
        try:
            carry_out(arrival)
            return None
        except Exception as error:
            if workspace.spark.sparkContext._jsc.sc().isStopped():
                raise  # not the dataset's doing; the batch is repeated after a restart
            log.warning("dataset %s, attempt %d: %s", arrival.dataset_id, arrival.attempts, str(error)[:500])
            return error

    def note(arrivals: Sequence[Arrival], outcome: str, messages: Sequence[str | None] = ()) -> None:
        if arrivals:
            texts = messages or [None] * len(arrivals)
            store.log_rows(
                "arrival_attempts",
                [(a.dataset_id, a.announced, a.attempts, outcome, t) for a, t in zip(arrivals, texts)],
                _ATTEMPT,
            )

    def started(arrivals: Sequence[Arrival]) -> None:
        for a in arrivals:
            a.attempts += 1
        note(arrivals, "started")

    def settle(arrivals: Sequence[Arrival], errors: Sequence[Exception | None]) -> list[Arrival]:
        """Write down how an attempt ended; the arrivals that are worth another one."""
        again, dead = [], []
        for a, error in zip(arrivals, errors):
            if error is not None:
                final = isinstance(error, DATASET_FAULTS) or a.attempts >= max_attempts
                (dead if final else again).append((a, error))
        note([a for a, error in zip(arrivals, errors) if error is None], "done")
        note([a for a, _ in again], "failed", [str(e)[:2000] for _, e in again])
        bury([a for a, _ in dead], [str(e)[:2000] for _, e in dead])
        return [a for a, _ in again]

    def bury(arrivals: Sequence[Arrival], messages: Sequence[str]) -> None:
        note(arrivals, "dead", messages)
        if arrivals:
            store.log_many([{"dataset_id": a.dataset_id, "status": "error"} for a in arrivals])

    def process(batch: DataFrame, _batch_id: int) -> None:
        pending = _earlier(store, _arrivals(batch))
        lost = [a for a in pending if a.attempts >= max_attempts]
        bury(lost, ["the driver did not survive an attempt"] * len(lost))
        pending = [a for a in pending if a.attempts < max_attempts]
        fresh = [a for a in pending if not a.attempts]
        again = [a for a in pending if a.attempts]
        if fresh:
            started(fresh)
            with ThreadPoolExecutor(max_workers=builds_at_once) as pool:
                again += settle(fresh, list(pool.map(tried, fresh)))
        while again:
            time.sleep(pause)
            failed = []
            for arrival in again:
                started([arrival])
                failed += settle([arrival], [tried(arrival)])
            again = failed

    writer = (
        workspace.spark.readStream.schema(ANNOUNCEMENT)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(inbox)
        .select(
            "*",
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_path").alias("file"),
        )
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def dead_letters(workspace: Workspace) -> DataFrame:
    """Announcements that were given up: dataset_id, announced, attempts, message, given_up_at."""
    return (
        workspace.store.read("arrival_attempts")
        .where("outcome = 'dead'")
        .select("dataset_id", "announced", F.col("attempt").alias("attempts"), "message", F.col("at").alias("given_up_at"))
    )


def _arrivals(batch: DataFrame) -> list[Arrival]:
    """One entry per dataset with the lines that count, in their order."""
    lines = batch.where("dataset_id IS NOT NULL").withColumn("place", F.monotonically_increasing_id())
    by_dataset = lines.groupBy("dataset_id").agg(
        # A bounded number of announcement files.
        F.sort_array(
            F.collect_list(F.struct("modified", "file", "place", "path", "format", "name", "mode"))
        ).alias("lines")
    )
    found = []
    for row in by_dataset.collect():
        replacing = [i for i, line in enumerate(row["lines"]) if line["mode"] != "append"]
        counting = row["lines"][replacing[-1] if replacing else 0 :]
        found.append(Arrival(row["dataset_id"], _announced(row["lines"]), counting))
    return sorted(found, key=lambda a: a.dataset_id)


def _announced(lines: Sequence[Row]) -> str:
    last = lines[-1]
    return f"{last['file']}#{last['modified']}#{len(lines)}"


def _earlier(store, arrivals: list[Arrival]) -> list[Arrival]:
    """The arrivals that an earlier run of the batch did not settle, with their attempts so far."""
    ids = [a.dataset_id for a in arrivals]
    seen = {
        (r["dataset_id"], r["announced"]): r
        for r in store.read("arrival_attempts")
        .where(F.col("dataset_id").isin(ids))
        .groupBy("dataset_id", "announced")
        .agg(F.max("attempt").alias("attempts"), F.bool_or(F.col("outcome").isin("done", "dead")).alias("settled"))
        .collect()
    }
    open_ = []
    for a in arrivals:
        row = seen.get((a.dataset_id, a.announced))
        a.attempts = row["attempts"] if row else 0
        if not (row and row["settled"]):
            open_.append(a)
    return open_
