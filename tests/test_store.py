import json
import os
import time

import pytest

from factloom import CommitConflict, Workspace
from factloom.sources import store as storage
from tests.test_workspace import sample

KNOWLEDGE = ["column_metadata", "column_stats", "group_statistics", "pairwise_evidence", "fact_combinations"]


def content(space, dataset_id, at=None):
    at = at or space.snapshot(dataset_id)
    return {t: sorted(map(str, at.read(t).collect())) for t in KNOWLEDGE}


@pytest.fixture
def space(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "space"))
    space.add(sample(spark), "sales", "one")
    space.process("one", ["sale_id"])
    return space


class Killed(BaseException):
    """Not an error that anything in the library handles, like the end of the process."""


def test_a_build_killed_between_any_two_writes_changes_nothing(spark, space, monkeypatch):
    before = content(space, "one")
    space.add(sample(spark, shift=5.0), "sales", "one")
    writes = []
    real = storage.Draft._stored

    def stop_at(n):
        def stored(self, table, writer):
            if len(writes) == n:
                raise Killed(table)
            writes.append(table)
            return real(self, table, writer)

        return stored

    n = 0
    while True:
        writes.clear()
        monkeypatch.setattr(storage.Draft, "_stored", stop_at(n))
        try:
            space.process("one", ["sale_id"])
            break
        except Killed:
            assert content(space, "one") == before
        n += 1
    assert n == len(writes) > len(KNOWLEDGE)
    after = content(space, "one")
    assert all(after[t] != before[t] for t in ("column_stats", "group_statistics", "fact_combinations"))


def test_the_manifest_is_the_switch(spark, space, monkeypatch):
    before = content(space, "one")
    space.add(sample(spark, shift=5.0), "sales", "one")

    def killed(self, dataset_id, manifest):
        raise Killed

    monkeypatch.setattr(storage.KnowledgeStore, "_create_manifest", killed)
    with pytest.raises(Killed):
        space.process("one", ["sale_id"])
    assert content(space, "one") == before
    monkeypatch.undo()

    # Killed right after the switch: the registry has not heard of it, readers of tables have.
    monkeypatch.setattr(storage.KnowledgeStore, "log_status", killed)
    with pytest.raises(TypeError):
        space.process("one", ["sale_id"])
    monkeypatch.undo()
    assert content(space, "one") != before
    assert space.facts("one", "region").count() == 3


def test_nothing_is_deleted_or_renamed_by_a_build(spark, space, tmp_path):
    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "space") for f in names}

    held = files()
    space.process("one", ["sale_id"])
    assert held <= files()


def test_pinned_reads_outlive_later_builds(spark, space):
    pinned = space.snapshot("one")
    before = content(space, "one", pinned)
    facts = sorted(map(str, space.facts("one", at=pinned).collect()))
    lazily = space.facts("one", at=pinned)
    space.add(sample(spark, shift=5.0), "sales", "one")
    space.process("one", ["sale_id"])
    assert content(space, "one", pinned) == before != content(space, "one")
    assert sorted(map(str, lazily.collect())) == facts
    assert space.evidence("one", "amount", "region", at=pinned).collect() != space.evidence("one", "amount", "region").collect()


def test_two_writers_with_one_base(spark, space):
    base = space.snapshot("one")
    first, second = (space.store.draft("one", base) for _ in range(2))
    for draft in (first, second):
        draft.keep("column_stats")
    first.commit()
    with pytest.raises(CommitConflict):
        second.commit()
    # Both find the number free; one of them creates the file.
    third, fourth = (space.store.draft("one", space.snapshot("one")) for _ in range(2))
    fourth.manifest.number = third.manifest.number = space.store._next_number("one", third.base)
    space.store._create_manifest("one", third.manifest)
    with pytest.raises(CommitConflict):
        space.store._create_manifest("one", fourth.manifest)
    # Without a base the last writer wins.
    last = space.store.draft("one")
    assert last.commit().manifest.number == space.snapshot("one").manifest.number


def test_a_torn_manifest_is_none(spark, space, monkeypatch):
    before = content(space, "one")
    number = space.snapshot("one").manifest.number
    torn = space.store._manifest_file("one", number + 1)
    with open(torn, "w") as f:
        f.write('{"number": 2, "tab')
    assert content(space, "one") == before
    # Its writer may still be alive: nobody goes past it yet.
    with pytest.raises(CommitConflict):
        space.store.replace("column_stats", "one", space.snapshot("one").read("column_stats").drop("dataset_id"))
    monkeypatch.setattr(storage, "TORN_SECONDS", 0.0)
    space.store.replace("column_stats", "one", space.snapshot("one").read("column_stats").drop("dataset_id"))
    assert space.snapshot("one").manifest.number == number + 2 and content(space, "one") == before


def test_vacuum_keeps_what_recent_manifests_name(spark, space):
    for shift in (1.0, 2.0):
        space.add(sample(spark, shift), "sales", "one")
        space.process("one", ["sale_id"])
    previous, now = content(space, "one"), None
    pinned = space.snapshot("one")
    space.add(sample(spark, 3.0), "sales", "one")
    space.process("one", ["sale_id"])
    now = content(space, "one")
    assert space.store.vacuum("one") == 0  # all of it is recent
    time.sleep(1.1)
    assert space.store.vacuum("one", keep=2, older_than=1.0) > 0
    assert content(space, "one") == now and content(space, "one", pinned) == previous
    assert space.store.vacuum("one", keep=2, older_than=1.0) == 0
    assert space.store.vacuum("one", keep=1, older_than=1.0) > 0
    assert content(space, "one") == now
    space.process("one", ["sale_id"])
    assert content(space, "one") == now


def test_datasets_with_one_table_written_at_a_time(spark, space):
    facts = space.snapshot("one").read("fact_combinations").drop("dataset_id")
    space.store.replace("fact_combinations", "two", facts.where("dimension = 'region'"), split_by="dimension")
    assert space.store.read("fact_combinations", "two").count() == 3
    assert {r[0] for r in space.store.read("fact_combinations").select("dataset_id").distinct().collect()} == {"one", "two"}
    space.store.replace("fact_combinations", "two", facts.limit(0), split_by="dimension")
    assert space.store.read("fact_combinations", "two").count() == 0
    assert space.store.read("column_stats", "none").count() == 0
    manifest = space.snapshot("one").manifest
    assert json.loads(json.dumps(manifest.notes))["row_count"] == 60
