import json

import pytest
from facts_data import CONTROLLER, SERVICE, controller, frame, service

from weftline.sources.snapshot import SnapshotStore
from weftline.streaming import passes


@pytest.fixture
def stream(spark, tmp_path):
    """Send events (dicts of facts) as one file and run the stream over it."""
    store, inbox = SnapshotStore(spark, f"file://{tmp_path}/store"), tmp_path / "inbox"
    inbox.mkdir()

    def send(*events, checkpoint="ck"):
        name = f"{len(list(inbox.iterdir())):03d}.json"
        (inbox / name).write_text("".join(json.dumps(e) + "\n" for e in events))
        run = passes.start(passes.stream_facts(spark, f"file://{inbox}"), store, f"file://{tmp_path}/{checkpoint}", once=True)
        run.awaitTermination()
        return {r.path: r.hash for r in store.current()["files"].collect()} if store.current() else None

    send.store = store
    return send


def at(record, day, **more):
    return record | {"at": f"2024-01-{day:02d}T00:00:00Z"} | more


def gone(path, day):
    return at({"path": path, "removed": True}, day)


def test_removed_late_and_repeated_files(stream):
    assert stream(at(service(), 2), at(controller(), 2)) == {SERVICE: "s0", CONTROLLER: "c"}
    version = stream.store.current().version
    assert stream(at(service(4), 1)) == {SERVICE: "s0", CONTROLLER: "c"}  # late
    assert stream(at(service(), 2), at(service(), 2)) == {SERVICE: "s0", CONTROLLER: "c"}  # twice the same again
    assert stream.store.current().version == version  # neither published anything
    assert stream(gone(SERVICE, 5), at(service(4), 4)) == {CONTROLLER: "c"}
    assert stream.store.current()["symbols"].where("file <> 'api/controller.ts'").count() == 0
    assert stream(at(service(4), 4), gone("never/there.ts", 4)) == {CONTROLLER: "c"}  # from before its removal
    assert stream(at(service(4), 6)) == {SERVICE: "s4", CONTROLLER: "c"}
    assert {(r.path, r.removed, r.at.day) for r in stream.store.current()["marks"].collect()} == {(SERVICE, False, 6), (CONTROLLER, False, 2), ("never/there.ts", True, 4)}
    # a second stream over all the files again, as after the loss of the checkpoint, ends at the same index
    before = stream.store.current().version
    assert stream(gone(CONTROLLER, 1), checkpoint="other") == {SERVICE: "s4", CONTROLLER: "c"}
    assert stream.store.current().version == before


def test_same_facts_later_move_the_mark_alone(stream):
    stream(at(service(), 2))
    assert stream(at(service(), 9)) == {SERVICE: "s0"}
    assert stream(at(service(4), 5)) == {SERVICE: "s0"}
    assert stream(at(service(4), 9), gone(SERVICE, 9)) == {}  # a removal goes before facts of the same time


def test_events_without_time_path_or_rows(stream, spark):
    assert stream({"path": SERVICE, "removed": True}) == {}
    assert stream(at(service(), 9), service(4), {"hash": "x"}) == {SERVICE: "s4"}
    passes.apply_batch(stream.store, frame(spark, service()))  # facts alone, without the stream's columns
    version = stream.store.current().version
    passes.apply_batch(stream.store, frame(spark))
    assert [r.hash for r in stream.store.current()["files"].collect()] == ["s0"] and stream.store.current().version == version
