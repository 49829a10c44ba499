"""A small full-stack repository: a form that enrolls patients over an Express API."""

import json

import pytest
from facts_data import call, frame, key, symbol
from pyspark.sql import functions as F

from weftline import config
from weftline.engine import Engine
from weftline.operators import contexts, documents, prompts
from weftline.sources.snapshot import SnapshotStore
from weftline.streaming import passes

APP, ROUTER, CTRL, FORM, HOOK = "api/app.ts", "api/routes.ts", "api/controller.ts", "web/Form.tsx", "web/useEnroll.ts"


def register(receiver, kind, call_kind, line, order, handlers, method=None, path=None):
    return {"receiver": {"key": receiver, "kind": kind}, "receiver_text": receiver.split("#")[1], "call_kind": call_kind, "method": method, "path": path, "path_text": None, "line": line, "end_line": line, "order_idx": order, "handlers": handlers}


def fn(file, name, line, arity=2):
    return {"kind": "symbol", "key": key(file, name, line), "arity": arity, "text": name}


def local(name, line):
    return {"name": name, "start_line": line}


def facts():
    react = {"props_type": None, "props": [], "state": [], "hooks": [], "context": [], "effects": [], "render": [], "handlers": []}
    return [
        {"path": APP, "hash": "1", "language": "typescript", "symbols": [symbol("requireAuth", 1, 3), symbol("errorHandler", 5, 8)], "calls": [], "imports": [],
         "router_calls": [register(f"{APP}#app", "app", "use", 10, 0, [{"kind": "package", "package": "express", "text": "express.json()"}]), register(f"{APP}#app", "app", "use", 11, 1, [{"kind": "router", "receiver_key": f"{ROUTER}#router", "text": "router"}], path="/api"), register(f"{APP}#app", "app", "use", 12, 2, [fn(APP, "errorHandler", 5, 4)])]},
        {"path": ROUTER, "hash": "2", "language": "typescript", "symbols": [], "calls": [], "imports": [{"imported_path": "express", "resolved_path": None, "imported_names": ["Router"], "package_name": "express", "package_version": "4.19.2"}],
         "router_calls": [register(f"{ROUTER}#router", "router", "use", 3, 0, [fn(APP, "requireAuth", 1)]), register(f"{ROUTER}#router", "router", "route", 5, 1, [fn(CTRL, "enroll", 1)], "POST", "/patients/enroll"), register(f"{ROUTER}#router", "router", "route", 6, 2, [fn(CTRL, "getPatient", 20)], "GET", "/patients/:id")]},
        {"path": CTRL, "hash": "3", "language": "typescript", "symbols": [symbol("enroll", 1, 8), symbol("insert", 10, 14, False), symbol("getPatient", 20, 22)], "imports": [{"imported_path": "pg", "resolved_path": None, "imported_names": ["Pool"], "package_name": "pg", "package_version": "8.12.0"}],
         "calls": [call(("enroll", 1), 3, "insert", key(CTRL, "insert", 10)), call(("enroll", 1), 6, "hooks[x]", resolved=False), call(("insert", 10), 12, "pool.query")],
         "side_effects": [{"symbol": local("insert", 10), "kind": "db_write", "detail": "INSERT consents", "line": 12}, {"symbol": local("enroll", 1), "kind": "throws", "detail": "ConflictError (409)", "line": 4}]},
        {"path": FORM, "hash": "4", "language": "typescript", "symbols": [symbol("EnrollForm", 1, 20, kind="component"), symbol("EnrollForm.handleSubmit", 3, 6, False)], "imports": [{"imported_path": "./useEnroll", "resolved_path": HOOK, "imported_names": ["useEnroll"], "package_name": None, "package_version": None}],
         "calls": [call(("EnrollForm", 1), 2, "useEnroll", key(HOOK, "useEnroll", 1)), call(("EnrollForm.handleSubmit", 3), 4, "mutate", key(HOOK, "useEnroll.mutate", 3))],
         "react_facts": [react | {"symbol": local("EnrollForm", 1), "hooks": [{"name": "useEnroll", "line": 2, "callee": key(HOOK, "useEnroll", 1), "package": None, "bindings": ["mutate"], "callbacks": [{"name": "onDone", "line": 2}]}],
                          "handlers": [{"element": "form", "event": "onSubmit", "handler": "handleSubmit", "line": 10, "end_line": 10, "target": key(FORM, "EnrollForm.handleSubmit", 3)}],
                          "render": [{"element": "Field", "kind": "component", "line": 12, "depth": 1, "component": None, "package": "ui-kit", "props": [], "condition": None}]}]},
        {"path": HOOK, "hash": "5", "language": "typescript", "symbols": [symbol("useEnroll", 1, 12, kind="hook"), symbol("useEnroll.mutate", 3, 9, False)], "imports": [],
         "calls": [call(("useEnroll.mutate", 3), 5, "api.post"), call(("useEnroll.mutate", 3), 7, "onDone", resolved=False)],
         "react_facts": [react | {"symbol": local("useEnroll", 1), "props": ["onDone"], "effects": [{"hook": "useEffect", "line": 10, "end_line": 11, "deps": ["id"], "binding": None}]}],
         "api_calls": [{"symbol": local("useEnroll.mutate", 3), "method": "POST", "url_pattern": "/api/patients/enroll", "url_text": "'/api/patients/enroll'", "line": 5}, {"symbol": local("useEnroll", 1), "method": "GET", "url_pattern": "/api/patients/:id", "url_text": "`x`", "line": 11}]},
    ]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")
    assert e.index(frame(spark, *facts())) == {"changed": 5, "removed": 0, "refreshed": 0}
    return e


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(f, [f"{f} {i}" for i in range(1, 31)], "h") for f in (APP, ROUTER, CTRL, FORM, HOOK)], "file string, lines array<string>, hash string")


def test_second_pass_does_nothing(spark, engine):
    before = engine.snapshot().version
    assert engine.index(frame(spark, *facts())) == {"changed": 0, "removed": 0, "refreshed": 0}
    assert engine.snapshot().version == before
    assert engine.stats().asDict() == {"files": 5, "symbols": 9, "calls": 7, "unresolved": 2}


def test_routes_and_edges(engine):
    assert [(r.method, r.full_path, r.handler_label) for r in engine.routes().collect()] == [("GET", "/api/patients/:id", "getPatient"), ("POST", "/api/patients/enroll", "enroll")]
    edges = engine.tables()["cross_edges"].join(engine.tables()["routes"], "route").collect()
    assert {(r.full_path, r.match, r.resolved) for r in edges} == {("/api/patients/enroll", "exact", True), ("/api/patients/:id", "exact", True)}


def test_lookups(spark, engine):
    assert [r.name for r in engine.symbols_in_range(CTRL, 8, 12).collect()] == ["enroll", "insert"]
    insert = engine.find_symbol(CTRL, "insert")
    assert [(r.name, r.call_line) for r in engine.callers(insert).collect()] == [("enroll", 3)]
    assert [r.detail for r in engine.side_effects(insert).collect()] == ["INSERT consents"]
    assert engine.api_calls().count() == 2


def test_endpoint(spark, engine, lines):
    asked = spark.createDataFrame([("a", "POST", "/api/patients/enroll"), ("b", "GET", "/api/patients/42"), ("c", "GET", "/nope")], "target string, method string, path string")
    got = engine.endpoint(asked, lines)
    assert {r.target: r.error for r in got["found"].collect()} == {"a": None, "b": None, "c": "No route matches GET /nope."}
    chain = got["chain"].where("target = 'a'").orderBy("position").collect()
    assert [(r.phase, r.label) for r in chain] == [("app", "express.json()"), ("router", "requireAuth"), ("handler", "enroll"), ("error", "errorHandler")]
    assert [(r.file, r.start, r.end) for r in got["registrations"].where("target = 'a'").orderBy("file", "start").collect()] == [(APP, 10, 12), (ROUTER, 3, 3), (ROUTER, 5, 5)]
    assert [(r.target, r.effect, r.detail) for r in got["effects"].collect()] == [("a", "db_write", "INSERT consents")]
    assert [(r.error, r.status) for r in got["error_paths"].collect()] == [("ConflictError", 409)]
    assert {(r.package, r.version) for r in got["packages"].where("target = 'a'").collect()} == {("express", "4.19.2"), ("pg", "8.12.0")}
    assert got["chain_hash"].select("chain_hash").distinct().count() == 2
    assert all(r.fits for r in got["code"].collect())
    diagram, notes = engine.endpoint_text("POST", "/api/patients/enroll", lines)
    assert "  Client->>P1: POST /api/patients/enroll" in diagram and "->>P" in diagram and "  alt ConflictError\n    P3-->>Client: 409\n  end" in diagram and diagram.endswith("P3-->>Client: response")
    assert "Mounted via: /api (api/app.ts:11)" in notes and "Can fail: ConflictError → 409 in enroll (api/controller.ts:4)" in notes


def test_component(spark, engine, lines):
    got = engine.component(spark.createDataFrame([("f", FORM, None), ("x", CTRL, "enroll"), ("n", CTRL, None)], "target string, file string, name string"), lines)
    errors = {r.target: r.error for r in got["picked"].collect()}
    assert errors["f"] is None and "not a component" in errors["x"] and "No component" in errors["n"]
    assert [(r.depth, r.symbol_id, r.used_by, r.called_at) for r in got["hooks"].collect()] == [(1, f"{HOOK}#useEnroll@1", "EnrollForm", f"{FORM}:2")]
    ways = {r.label: r.path for r in got["triggers"].collect()}
    assert ways == {"onSubmit on <form>": ["EnrollForm.handleSubmit", "useEnroll.mutate"], "useEffect [id] in useEnroll": ["useEnroll"]}
    assert {r.note for r in got["unresolved"].collect()} == {f"unresolved: likely the `onDone` callback EnrollForm passes to useEnroll ({FORM}:2)"}
    assert [(r.element, r.package, r.child) for r in got["children"].collect()] == [("Field", "ui-kit", None)]
    assert got["structure_hash"].count() == 1


def test_trace(spark, engine, lines):
    diagram, notes = engine.trace_text("POST", "/api/patients/enroll", lines)
    assert diagram.split("\n")[:4] == ["sequenceDiagram", "  actor User", "  participant C as EnrollForm", "  participant F1 as useEnroll.ts"]
    for line in ("  User->>C: onSubmit on <form>", "  C->>C: handleSubmit()", "  C->>F1: mutate()", "  F1->>P1: POST /api/patients/enroll", "    P3-->>F1: 409", "  P3-->>F1: response", "  Note over F1: then onDone()"):
        assert line in diagram.split("\n")
    assert "Client" not in diagram and notes[0] == "Trace: EnrollForm → POST /api/patients/enroll"
    effect, _ = engine.trace_text("GET", "/api/patients/42", lines)
    assert "  Note over C: useEffect [id] in useEnroll" in effect and "User->>" not in effect
    with pytest.raises(contexts.TargetError):
        engine.trace_text("GET", "/nope", lines)


def test_config(tmp_path):
    (tmp_path / "apps/api").mkdir(parents=True)
    (tmp_path / "web").mkdir()
    assert (config.default(tmp_path).backend, config.default(tmp_path).frontend) == ("apps/api", "web")
    folder = tmp_path / config.FOLDER
    folder.mkdir()
    (folder / config.NAME).write_text(json.dumps({"roots": {"backend": "apps/api"}, "pinnedEdges": [], "keep": 1}))
    assert config.find_root(tmp_path / "apps/api") == tmp_path.resolve()
    for route in ("GET /a", "GET /b"):
        config.add_pin(tmp_path, config.Pin("f#g", "GET", "/x", route))
    loaded = config.load(tmp_path)
    assert [p.route for p in loaded.pins] == ["GET /b"] and json.loads((folder / config.NAME).read_text())["keep"] == 1
    (folder / config.NAME).write_text(json.dumps({"roots": {"backend": "missing"}}))
    with pytest.raises(config.ConfigError, match="not a directory"):
        config.load(tmp_path)


def test_stream_of_facts(spark, tmp_path):
    inbox, store = tmp_path / "in", SnapshotStore(spark, f"file://{tmp_path}/index")
    inbox.mkdir()
    (inbox / "1.json").write_text("\n".join(json.dumps(f) for f in facts()))
    run = lambda: passes.start(passes.stream_facts(spark, f"file://{inbox}"), store, f"file://{tmp_path}/ck", once=True).awaitTermination()
    run()
    assert store.current()["symbols"].count() == 9
    version = store.current().version
    passes.apply_batch(store, frame(spark, *facts()))
    assert store.current().version == version


def test_documents(spark):
    old = spark.createDataFrame([("fn", "a", "x", 1), ("fn", "b", "y", 1)], "kind string, ref string, content string, created_at int")
    new = spark.createDataFrame([("fn", "a", "x", 9), ("fn", "b", "z", 9), ("fn", "c", "w", 9)], old.schema)
    assert sorted(map(tuple, documents.save(old, new).collect())) == [("fn", "a", "x", 1), ("fn", "b", "z", 9), ("fn", "c", "w", 9)]
    asked = spark.createDataFrame([(4, "fn", "a", "s1", "why?", 1)], "id long, kind string, ref string, step_id string, question string, created_at int")
    assert sorted(r.id for r in documents.ask(asked, asked.withColumn("created_at", F.lit(2))).collect()) == [4, 5]
    cases = [("express", "Router", "4.19.2", "express", None, None), ("react", "useState", None, "react", None, None), ("node", "readFile", None, "node:fs/promises", None, None), ("left", "x", "1.2.3", "left", None, None), ("right", "x", "1", "right", None, "github:a/b"), ("zod", "z", "^3.1", "zod", None, None)]
    frame_ = spark.createDataFrame(cases, "p string, s string, v string, i string, h string, r string")
    got = {r.p: (r.u.url, r.u.source) for r in frame_.select("p", documents.documentation_url(*map(F.col, "psvihr")).alias("u")).collect()}
    assert got == {
        "express": ("https://expressjs.com/en/4x/api.html#express.router", "curated"), "react": ("https://react.dev/reference/react/useState", "curated"), "node": ("https://nodejs.org/api/fs.html", "curated"),
        "left": ("https://www.npmjs.com/package/left/v/1.2.3", "npm"), "right": ("https://github.com/a/b", "package.json"), "zod": ("https://v3.zod.dev/", "curated"),
    }


def test_fn_prompts(spark, engine, lines):
    targets = spark.createDataFrame([("t", CTRL, "enroll", None, None), ("none", CTRL, "gone", None, None)], "target string, file string, symbol string, start int, end int")
    rows = {r.target: r for r in prompts.fn_prompts(engine.tables(), engine.fn(targets, lines), condensed=True).collect()}
    assert rows["none"].prompt is None and "No symbol" in rows["none"].error
    text = rows["t"].prompt
    titles = [line for line in text.split("\n") if line.startswith("#")]
    assert titles[0] == f"# Target: function enroll at {CTRL}:1-8" and titles[1:4] == ["## Callers", "## Callees", "## Code"]
    assert f"target {CTRL}:1-8" in text and "hooks[x]" in text and "- pg@8.12.0: Pool" in text and f"- {CTRL}: " in text
    assert text.rsplit("\n\n", 1)[1].startswith(f"Write the walkthrough of {CTRL}:1-8.")
