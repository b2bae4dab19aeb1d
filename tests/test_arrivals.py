import json

import pytest

from factloom import Workspace
from factloom.streaming import arrivals
from factloom.streaming.arrivals import dead_letters, watch_inbox
from tests.test_workspace import sample


class Inbox:
    def __init__(self, spark, tmp_path):
        self.space, self.folder, self.base = Workspace(spark, str(tmp_path / "space")), tmp_path / "inbox", tmp_path
        self.folder.mkdir()

    def announce(self, name, *lines, **options):
        fields = ("dataset_id", "path", "mode")
        text = "\n".join(json.dumps(dict(zip(fields, line))) for line in lines)
        (self.folder / f"{name}.json").write_text(text + "\n")
        return self.run(**options)

    def run(self, **options):
        watch_inbox(self.space, str(self.folder), str(self.base / "progress"), pause=0.0, **options).awaitTermination()
        return {r["dataset_id"]: (r["status"], r["row_count"]) for r in self.space.datasets().collect()}

    def attempts(self):
        rows = self.space.store.read("arrival_attempts").where("outcome = 'started'").collect()
        return {i: max(r["attempt"] for r in rows if r["dataset_id"] == i) for i in {r["dataset_id"] for r in rows}}


@pytest.fixture
def inbox(spark, tmp_path):
    sample(spark).write.parquet(str(tmp_path / "good"))
    sample(spark, 3.0).write.parquet(str(tmp_path / "more"))
    (tmp_path / "corrupt").mkdir()
    sample(spark).coalesce(1).write.parquet(str(tmp_path / "half"))
    for part in (tmp_path / "half").glob("part-*.parquet"):
        # A whole footer over damaged pages: opening works, reading does not.
        whole = part.read_bytes()
        (tmp_path / "corrupt" / part.name).write_bytes(whole[:4] + b"\xff" * (len(whole) // 2) + whole[4 + len(whole) // 2 :])
    return Inbox(spark, tmp_path)


def test_a_corrupt_file_ends_as_error_and_the_stream_goes_on(inbox):
    good, corrupt = str(inbox.base / "good"), str(inbox.base / "corrupt")
    found = inbox.announce("1", ("bad", corrupt), ("first", good), ("none", str(inbox.base / "nothing")), max_attempts=2)
    assert found["first"] == ("processed", 60)
    assert found["bad"][0] == found["none"][0] == "error"
    assert inbox.attempts() == {"bad": 2, "first": 1, "none": 1}
    dead = {r["dataset_id"]: r for r in dead_letters(inbox.space).collect()}
    assert set(dead) == {"bad", "none"} and dead["bad"]["attempts"] == 2 and dead["bad"]["message"]
    assert inbox.announce("2", ("second", good))["second"] == ("processed", 60)
    # A dataset that is announced anew, now whole, starts from the beginning.
    assert inbox.announce("3", ("bad", good))["bad"] == ("processed", 60)


def test_a_passing_fault_is_tried_again(inbox, monkeypatch):
    real, calls = Workspace.process, []

    def flaky(self, dataset_id, **options):
        calls.append(dataset_id)
        if len(calls) == 1:
            raise RuntimeError("executor lost")
        real(self, dataset_id, **options)

    monkeypatch.setattr(Workspace, "process", flaky)
    assert inbox.announce("1", ("first", str(inbox.base / "good"))) == {"first": ("processed", 60)}
    assert inbox.attempts() == {"first": 2} and dead_letters(inbox.space).count() == 0


def test_attempts_outlive_the_driver(inbox, monkeypatch):
    # What a run leaves behind that ended with its driver: attempts that were begun only.
    monkeypatch.setattr(arrivals, "_announced", lambda lines: "here")
    begun = [("bad", "here", n, "started", None) for n in (1, 2, 3)] + [("first", "here", 1, "started", None)]
    inbox.space.store.log_rows("arrival_attempts", begun + [("second", "here", 1, "done", None)], arrivals._ATTEMPT)
    good = str(inbox.base / "good")
    found = inbox.announce("1", ("bad", good), ("first", good), ("second", good))
    assert found == {"bad": ("error", None), "first": ("processed", 60)}
    assert inbox.attempts() == {"bad": 3, "first": 2}
    assert [r["dataset_id"] for r in dead_letters(inbox.space).collect()] == ["bad"]


def test_appended_and_replacing_lines(inbox):
    good, more = str(inbox.base / "good"), str(inbox.base / "more")
    found = inbox.announce("1", ("one", more), ("one", good), ("one", more, "append"), ("two", good, "append"))
    assert found["one"] == ("processed", 120) and found["two"][0] == "error"
    assert inbox.announce("2", ("one", more, "append"))["one"] == ("processed", 120)
    assert inbox.announce("3", ("one", good))["one"] == ("processed", 60)


def test_announcements_without_an_id_are_left_out(inbox):
    assert inbox.announce("1", (None, str(inbox.base / "good"))) == {}
    assert arrivals._earlier(inbox.space.store, []) == []
