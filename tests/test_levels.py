"""Passes that write what changes: equal to a whole rebuild, in the buckets of what changed, and without traces of crashes."""

import random
from pathlib import Path

import pytest
from facts_data import frame
from pyspark.sql import functions as F

from weftline.sources import levels, snapshot


def fact_file(rng, i, files):
    """A file with functions, calls, registrations and API calls that lead to other files at random."""
    path = f"f{i}.ts"
    names = [(f"fn{k}", 1 + 5 * k) for k in range(rng.randint(1, 3))]
    symbols = [{"name": n, "kind": "function", "start_line": at, "end_line": at + 3, "exported": True, "signature": n} for n, at in names]
    some = lambda: {"file": f"f{rng.randrange(files)}.ts", "name": f"fn{rng.randrange(3)}", "start_line": 1 + 5 * rng.randrange(3)}
    local = lambda: dict(zip(("name", "start_line"), rng.choice(names), strict=True))
    calls = [{"caller": local(), "callee": some(), "callee_text": "x", "line": k, "resolved": True} for k in range(rng.randint(0, 3))]
    receiver = {"key": f"f{i}.ts#{'app' if i % 3 == 0 else 'r'}", "kind": "app" if i % 3 == 0 else "router"}
    registrations = []
    for k in range(rng.randint(0, 4)):
        use = rng.random() < 0.5
        other = rng.randrange(files)
        router = {"kind": "router", "receiver_key": f"f{other}.ts#{'app' if other % 3 == 0 else 'r'}", "text": f"r{other}"}
        fn = lambda: {"kind": "symbol", "key": some(), "arity": rng.choice([2, 3, 4]), "text": "h"}
        registrations.append({
            "receiver": None if rng.random() < 0.1 else receiver, "receiver_text": "r", "call_kind": "use" if use else "route", "method": None if use else "GET", "path": None if rng.random() < 0.15 else rng.choice(["/a", "/b", "/:id", None]),
            "path_text": "expr", "line": k + 1, "end_line": k + 1, "order_idx": k, "handlers": [router if use and rng.random() < 0.7 else fn(), *([fn()] if rng.random() < 0.3 else [])],
        })
    api = [{"symbol": local(), "method": rng.choice(["GET", "UNKNOWN"]), "url_pattern": rng.choice(["/a", "/b/a", "/a/:id", "/b"]), "url_text": "u", "line": 3} for _ in range(rng.randint(0, 2))]
    return {"path": path, "hash": str(rng.random()), "language": "typescript", "symbols": symbols, "calls": calls, "router_calls": registrations, "api_calls": api}


def contents(snap):
    plain = lambda t: sorted(map(str, (r.asDict(recursive=True) for r in t.collect())))
    return {n: plain(t.select(sorted(t.columns))) for n, t in snap.tables.items() if n != "settings"}


def test_random_edits_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    files = 6
    facts = {i: fact_file(rng, i, files) for i in range(files)}
    pins = spark.createDataFrame([("f1.ts#fn0", "GET", "/a", "GET /a", 0), ("f2.ts#fn1", "GET", "/b", "GET /b/a", 1)], "caller string, method string, url string, route string, position int")
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/grown")
    store.apply(frame(spark, *facts.values()), pins=pins)
    for step in range(3):
        removed = []
        for i in rng.sample(range(files), 2):
            if i in facts and rng.random() < 0.3:
                removed.append(f"f{i}.ts")
                del facts[i]
            else:
                facts[i] = fact_file(rng, i, files)
        present = spark.createDataFrame([(f["path"], f["hash"]) for f in facts.values()], "path string, hash string")
        changed, gone, refreshed = ([r.path for r in x.collect()] for x in snapshot.plan_pass(store.current(), present))
        assert sorted(gone) == sorted(removed)
        again = [f for f in facts.values() if f["path"] in changed or f["path"] in refreshed]
        store.apply(frame(spark, *again), gone, refreshed, pins if step != 1 else None)
    rebuilt = snapshot.SnapshotStore(spark, f"file://{tmp_path}/whole").apply(frame(spark, *facts.values()), pins=pins)
    assert contents(store.current()) == contents(rebuilt)


def data_files(root):
    return {p for p in Path(root).rglob("*.parquet") if p.is_file()}


def test_a_changed_file_writes_its_bucket_only(spark, tmp_path):
    rows = spark.range(10_000).select(F.concat(F.lit("f"), "id").alias("file"), "id", F.lit(0).alias("version"))
    store = snapshot.SnapshotStore(spark, str(tmp_path / "index"))
    store.publish({"imports": rows, "declarations": rows})
    before = data_files(tmp_path)
    one = rows.where("file = 'f77'")
    snap = store.change({"imports": one.withColumn("version", F.lit(1))}, {"imports": {"file": one.select("file")}})
    (written,) = [p for p in data_files(tmp_path) - before if "-gone-" not in str(p)]
    (number,) = one.select(levels.bucket(F.col("file"))).first()
    assert written.parent.name == f"in_bucket={number}" and before <= data_files(tmp_path)
    assert snap["imports"].count() == 10_000 and [r.version for r in snap["imports"].where("version = 1").collect()] == [1] and snap["declarations"].count() == 10_000
    # a look-up opens the buckets of its keys
    found = store.rows_of("imports", ["f77", "f5"])
    assert sorted((r.file, r.version) for r in found.collect()) == [("f5", 0), ("f77", 1)]
    wanted = {levels_ for (levels_,) in rows.where("file in ('f77', 'f5')").select(levels.bucket(F.col("file"))).collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(wanted) == 2
    scanned = {int(f.split("in_bucket=")[1].split("/")[0]) for f in found.where("1 = 1").inputFiles() if "in_bucket=" in f}
    assert scanned >= wanted


def test_levels_are_merged_and_old_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(levels, "MOST_LEVELS", 3)
    rows = lambda keys, v: spark.createDataFrame([(f"f{k}", v) for k in keys], "file string, version int")
    store = snapshot.SnapshotStore(spark, str(tmp_path / "index"))
    store.publish({"imports": rows(range(200), 0)})
    expected = dict.fromkeys((f"f{k}" for k in range(200)), 0)
    rng = random.Random(2)
    for v in range(1, 9):
        keys = rng.sample(range(200), 5)
        lost = rows([*keys, rng.randrange(200)], v).select("file")
        for (f,) in lost.collect():
            expected.pop(f, None)
        expected |= {f"f{k}": v for k in keys}
        snap = store.change({"imports": rows(keys, v)}, {"imports": {"file": lost}})
        assert dict(map(tuple, snap["imports"].collect())) == expected
        assert len(store._now()[1].tables["imports"].rows) <= 4
    named = {f for n in (1, 2, 3) for f in store._manifest(store._read(store._number() + 1 - n)).folders()}
    assert {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("d-")} == named


def test_crashes_and_conflicts_leave_nothing(spark, tmp_path, monkeypatch):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "index"))
    rng = random.Random(4)
    store.apply(frame(spark, fact_file(rng, 0, 2), fact_file(rng, 1, 2)))
    folders = lambda: {p.name for p in (tmp_path / "index").iterdir()}
    kept = folders()
    monkeypatch.setattr(snapshot, "changed_links", lambda *a, **b: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.apply(frame(spark, fact_file(rng, 0, 2)))
    monkeypatch.undo()
    assert folders() == kept
    monkeypatch.setattr(store, "_number", lambda: 0)
    with pytest.raises(snapshot.VersionConflict):
        store.publish({"imports": spark.createDataFrame([("a",)], "file string")})
    monkeypatch.undo()
    assert folders() == kept and store.current()["files"].count() == 2
    # a writer that died: its folders are another's until the time of grace is over
    for name in ("d-lost", "v-lost"):
        (tmp_path / "index" / name).mkdir()
    assert store.sweep() == [] and store.sweep(grace=-60) == ["d-lost", "v-lost"]
    assert folders() == kept and store.current()["files"].count() == 2
