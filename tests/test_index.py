import pytest
from facts_data import CONTROLLER, SERVICE, call, controller, frame, key, service, symbol
from pyspark.sql import functions as F

from weftline.operators import contexts, graph
from weftline.sources import facts as facts_io
from weftline.sources import snapshot

ENROLL, HANDLE, PING, PONG = f"{SERVICE}#enroll@5", f"{CONTROLLER}#handle@3", f"{SERVICE}#ping@14", f"{SERVICE}#pong@18"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: t.cache() for n, t in facts_io.expand(frame(spark, service(), controller())).items()}


def callees(spark, tables, root, depth):
    rows = graph.callees(contexts.call_edges(tables), spark.createDataFrame([(root,)], "r string"), depth).collect()
    return [(r.depth, r.callee_text, r.dst is not None, r.resolved) for r in sorted(rows, key=lambda r: (r.depth, r.call_line))]


def test_callees(spark, tables):
    assert callees(spark, tables, ENROLL, 1) == [(1, "normalize", True, True), (1, "pool.query", False, True), (1, "handlers[name]", False, False)]
    assert [x[:2] for x in callees(spark, tables, HANDLE, 2)] == [(1, "enroll"), (2, "normalize"), (2, "pool.query"), (2, "handlers[name]")]
    assert [x[:2] for x in callees(spark, tables, PING, 10)] == [(1, "pong"), (2, "ping")]


def test_unknown_callee_is_kept_and_unknown_caller_aborts(spark):
    odd = controller() | {"calls": [call(("handle", 3), 4, "gone", key(SERVICE, "gone", 99))]}
    (row,) = facts_io.expand(frame(spark, service(), odd))["calls"].where("file = 'api/controller.ts'").collect()
    assert (row.callee_id, row.resolved, row.callee_text) == (None, False, "gone")
    with pytest.raises(facts_io.FactsError, match="1 rows of calls"):
        facts_io.expand(frame(spark, service(), controller() | {"calls": [call(("nobody", 1), 4, "x")]}))


def test_incremental_pass(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, f"file://{tmp_path}/index")
    assert store.current() is None
    first = store.apply(frame(spark, service(), controller()), settings={"pins": "none"})
    assert (first["files"].count(), first["symbols"].count(), first["calls"].count(), first["calls"].where("not resolved").count()) == (2, 5, 6, 1)
    present = spark.createDataFrame([(SERVICE, "s2"), (CONTROLLER, "c"), ("api/new.ts", "n")], "path string, hash string")
    changed, removed, refreshed = (sorted(r.path for r in x.collect()) for x in snapshot.plan_pass(first, present))
    assert (changed, removed, refreshed) == (["api/new.ts", SERVICE], [], [CONTROLLER])
    # moving enroll drops the edge into it until its caller is refreshed
    moved = store.apply(frame(spark, service(2)))
    assert moved["calls"].where(F.col("file") == CONTROLLER).count() == 0
    healed = store.apply(frame(spark, controller(7)), refreshed=[CONTROLLER])
    (edge,) = healed["calls"].where(F.col("file") == CONTROLLER).collect()
    assert (edge.caller_id, edge.callee_id) == (HANDLE, f"{SERVICE}#enroll@7")
    assert healed["files"].count() == 2 and healed["calls"].count() == 6
    with pytest.raises(facts_io.FactsError):
        store.apply(frame(spark, controller() | {"calls": [call(("nobody", 1), 4, "x")]}))
    assert store.current().version == healed.version
    gone = store.apply(frame(spark), removed=[SERVICE])
    assert [r.path for r in gone["files"].collect()] == [CONTROLLER] and gone["side_effects"].count() == 0 and gone["calls"].count() == 0
    blank = store.invalidate("settings", "new")
    assert {r.hash for r in blank["files"].collect()} == {""} and dict(map(tuple, blank["settings"].collect())) == {"pins": "none", "settings": "new"}
    store.drop()
    assert store.current() is None


def test_fn_context(spark, tables):
    lines = spark.createDataFrame([(SERVICE, [f"line {i}" for i in range(1, 22)], "h"), (CONTROLLER, [f"c {i}" for i in range(1, 9)], "h")], "file string, lines array<string>, hash string")
    targets = spark.createDataFrame([("t1", SERVICE, "enroll", None, None), ("t2", CONTROLLER, None, 4, 5), ("bad", SERVICE, "nope", None, None), ("lost", "x.ts", "a", None, None), ("far", CONTROLLER, None, 2, 90)], "target string, file string, symbol string, start int, end int")
    got = contexts.fn_context(tables, lines, targets)
    errors = {r.target: r.error for r in got["spans"].collect()}
    assert errors["t1"] is None and "No symbol" in errors["bad"] and "not in the index" in errors["lost"] and "out of bounds" in errors["far"]
    assert {(r.target, r.depth, r.callee_text) for r in got["callees"].collect()} == {("t1", 1, "normalize"), ("t1", 1, "pool.query"), ("t1", 1, "handlers[name]"), ("t2", 1, "enroll"), ("t2", 2, "normalize"), ("t2", 2, "pool.query"), ("t2", 2, "handlers[name]")}
    assert [(r.target, r.caller_id, r.call_line) for r in got["callers"].collect()] == [("t1", HANDLE, 4)]
    assert {(r.target, r.package, r.version) for r in got["packages"].collect()} == {("t1", "pg", "8.12.0")}
    assert {(r.target, r.file, r.line_count) for r in got["files"].collect()} == {("t1", SERVICE, 21), ("t1", CONTROLLER, 8), ("t2", SERVICE, 21), ("t2", CONTROLLER, 8)}
    code = {(r.target, r.part, r.key): (r.start, r.shown_end, r.fits) for r in got["code"].collect()}
    assert code["t1", "target", ENROLL] == (5, 12, True) and code["t1", "caller", HANDLE] == (3, 6, True)
    assert all("dynamic call in enroll" in r.note for r in got["unresolved"].collect())
    tight = {(r.target, r.part): r.fits for r in contexts.fn_context(tables, lines, targets, tokens=3000 + 40)["code"].collect()}
    assert tight["t1", "target"] and not tight["t1", "caller"]


def test_file_context(spark, tables):
    lines = spark.createDataFrame([(SERVICE, ["x"] * 21, "h")], "file string, lines array<string>, hash string")
    got = contexts.file_context(tables, lines)
    order = [(r.name, r.cycle) for r in sorted(got["order"].where(F.col("file") == SERVICE).collect(), key=lambda r: r.position)]
    note = "ping and pong call each other; walked in source order"
    assert order == [("normalize", None), ("enroll", None), ("ping", note), ("pong", note)]
    assert [(r.file, r.importer, r.imported_names) for r in got["importers"].collect()] == [(SERVICE, CONTROLLER, ["enroll"])]
    assert {r.name for r in got["helpers"].collect()} == {"ping", "pong"}


def test_scan_tree_and_versions(spark, tmp_path):
    for name, text in {"a/x.ts": "one", "a/y.d.ts": "no", "node_modules/p/z.js": "no", "b/skip.js": "no", "b/k.jsx": "two", "n.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.path, r.language, r.text) for r in facts_io.scan_tree(spark, f"file://{tmp_path}", ["b/skip*"]).collect()}
    assert got == {("a/x.ts", "typescript", "one"), ("b/k.jsx", "javascript", "two")}
    manifests = spark.createDataFrame([("p", "", "1.0", True), ("p", "a/b", "^2", False), ("q", "a", "^3", False)], "package string, directory string, version string, installed boolean")
    wanted = spark.createDataFrame([("p", "a/b"), ("q", "a/b"), ("r", "a")], "package string, directory string")
    assert {(r.package, r.version) for r in facts_io.package_versions(wanted, manifests).collect()} == {("p", "1.0"), ("q", "^3")}


def test_symbols_helper():
    assert symbol("a", 1, 2)["exported"] is True


def test_two_writers_and_a_crash_before_the_pointer(spark, tmp_path, monkeypatch):
    from weftline.sources.snapshot import KEPT, SnapshotStore, VersionConflict

    store = SnapshotStore(spark, str(tmp_path / "index"))
    first = store.apply(frame(spark, service(), controller()))
    # a writer that read the version before this one must not replace it
    second = store.invalidate("k", "1")
    with pytest.raises(VersionConflict):
        store.publish(first.tables, first.version)
    assert store.current().version == second.version
    # two writers that both saw the second version: the number is taken
    monkeypatch.setattr(store, "_number", lambda: 1)
    monkeypatch.setattr(store, "_read", lambda number: second.version)
    with pytest.raises(VersionConflict):
        store.publish(second.tables, second.version)
    monkeypatch.undo()
    # tables written, pointer not: readers stay where they were
    second["files"].write.parquet(f"{store.root}/v-lost/files")
    assert store.current().version == second.version and store.current()["files"].count() == 2
    for i in range(KEPT + 1):
        last = store.invalidate("k", str(i + 2))
    kept = [p for p in (tmp_path / "index").iterdir() if p.name.startswith("v-") and p.name != "v-lost"]
    assert last.version in {p.name for p in kept} and first.version not in {p.name for p in kept} and second.version not in {p.name for p in kept}


def test_migrations_go_forward_and_back(spark, tmp_path):
    from weftline.sources.migrations import migrate, new_columns, new_table, version_of
    from weftline.sources.snapshot import SnapshotStore

    steps = [new_table("notes", "file string, note string"), new_columns("symbols", {"doc": "string", "rank": "int"}, rereads=True)]
    store = SnapshotStore(spark, str(tmp_path / "index"))
    assert migrate(store, steps) is None
    first = store.apply(frame(spark, service(), controller()), settings={"pins": "none"})
    hashes = {r.path: r.hash for r in first["files"].collect()}
    one = migrate(store, steps, 1)
    assert version_of(first) == 0 and version_of(one) == 1 and one["notes"].columns == ["file", "note"] and {r.path: r.hash for r in one["files"].collect()} == hashes
    two = migrate(store, steps)
    assert version_of(two) == 2 and {r.doc for r in two["symbols"].collect()} == {None} and {r.hash for r in two["files"].collect()} == {""}
    assert migrate(store, steps).version == two.version  # nothing to do
    # a pass keeps what migrations have added
    again = store.apply(frame(spark, service(), controller()))
    assert version_of(again) == 2 and "notes" in again.tables and "rank" in again["symbols"].columns and {r.path: r.hash for r in again["files"].collect()} == hashes
    for wanted, known in ((3, steps), (-1, steps), (None, steps[:1])):
        with pytest.raises(ValueError, match="cannot go"):
            migrate(store, known, wanted)
    back = migrate(store, steps, 0)
    assert version_of(back) == 0 and "notes" not in back.tables and back["symbols"].columns == first["symbols"].columns
    assert dict(map(tuple, back["settings"].collect()))["pins"] == "none"


def test_locale_order_and_redacted_urls(spark):
    from weftline.functions import paths, text

    names = spark.createDataFrame([(n,) for n in ("b", "A", "a", "B", "_x", "\u00e9", "a-b", "ab", "a b", "z", "10", "2")], "n string")
    assert [r.n for r in names.orderBy(*text.locale_order(F.col("n"))).collect()] == ["_x", "10", "2", "a", "A", "a b", "a-b", "ab", "b", "B", "\u00e9", "z"]
    urls = {
        "postgres://u:p@h/db": "postgres://u:***@h/db",
        "postgres://u:p:q@r@h:5432/db?x=a:b@c": "postgres://u:***@h:5432/db?x=a:b@c",
        "postgres://:p@h": "postgres://:***@h",
        "postgres://u@h:80/x@y": "postgres://u@h:80/x@y",
        "http://h:80/a:b@c": "http://h:80/a:b@c",
        "no url: a:b@c": "no url: a:b@c",
        "": "",
        None: None,
    }
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", paths.redacted_url(F.col("u")).alias("r")).collect()
    assert {r.u: r.r for r in got} == urls
