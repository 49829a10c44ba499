from pyspark.sql import functions as F

from weftline.operators import routes
from weftline.sources.facts import HANDLER

CALLS = f"seq int, file string, receiver_key string, receiver_kind string, receiver_text string, call_kind string, method string, path string, path_text string, line int, end_line int, order_idx int, handlers array<{HANDLER}>"


def fn(name, arity=3):
    return {"kind": "symbol", "key": {"file": "m.ts", "name": name, "start_line": 1}, "arity": arity, "text": name}


def router(key):
    return {"kind": "router", "receiver_key": key, "text": key.split("#")[1]}


def package(text):
    return {"kind": "package", "package": "express", "text": text}


def registrations(spark, rows):
    full = []
    for n, (receiver, kind, line, path, *handlers) in enumerate(rows):
        owner = "app" if receiver and receiver.endswith("app") else "router"
        dynamic = path == "<dynamic>"
        full.append((n, receiver.split("#")[0] if receiver else "odd.ts", receiver, owner if receiver else None, receiver.split("#")[1] if receiver else "thing", "use" if kind == "use" else "route", None if kind == "use" else kind, None if dynamic else path, "prefix" if dynamic else None, line, line, n, list(handlers)))
    return spark.createDataFrame(full, CALLS)


def shown(spark, rows):
    found, middleware, warnings = (x.cache() for x in routes.stitch(registrations(spark, rows)))
    label = routes.handler_label(F.col("handler"))
    chains = {}
    for r in middleware.withColumn("label", label).orderBy("route", "order_idx").collect():
        chains.setdefault(r.route, []).append(f"{r.phase}:{r.label}")
    out = {f"{r.method} {r.full_path} -> {r.label}": " ".join(chains.get(r.route, [])) for r in found.withColumn("label", label).collect()}
    return out, sorted(r.message for r in warnings.collect()), {f"{r.method} {r.full_path}": (r.warnings, [m.prefix for m in r.mount_chain]) for r in found.collect()}


def test_nested_mounts(spark):
    out, warnings, more = shown(spark, [
        ("a.ts#app", "use", 9, None, package("express.json()")), ("a.ts#app", "use", 10, "/api", router("b.ts#api")), ("a.ts#app", "use", 11, None, fn("errorHandler", 4)),
        ("b.ts#api", "use", 6, "/patients", router("c.ts#patients")), ("c.ts#patients", "use", 11, None, fn("requireAuth")),
        ("c.ts#patients", "POST", 13, "/enroll", fn("rateLimit"), fn("enrollHandler", 2)), ("c.ts#patients", "GET", 14, "/:id", fn("getPatientHandler", 2)),
    ])
    assert out == {
        "POST /api/patients/enroll -> enrollHandler": "app:express.json() router:requireAuth route:rateLimit error:errorHandler",
        "GET /api/patients/:id -> getPatientHandler": "app:express.json() router:requireAuth error:errorHandler",
    }
    assert warnings == [] and more["GET /api/patients/:id"] == ([], ["/api", "/patients"])


def test_scopes_and_order(spark):
    out, _, _ = shown(spark, [
        ("a.ts#app", "use", 1, None, fn("earlyErrors", 4)), ("a.ts#app", "use", 2, "/admin", fn("adminOnly")), ("a.ts#app", "GET", 3, "/admin/users", fn("users")), ("a.ts#app", "GET", 4, "/health", fn("health")),
        ("a.ts#app", "GET", 5, "/administrators", fn("admins")), ("a.ts#app", "use", 6, None, fn("late")), ("a.ts#app", "use", 7, None, fn("onError", 4)),
    ])
    assert out == {"GET /admin/users -> users": "app:adminOnly error:onError", "GET /health -> health": "error:onError", "GET /administrators -> admins": "error:onError"}


def test_warnings_loops_and_dynamic_paths(spark):
    out, warnings, more = shown(spark, [
        ("a.ts#app", "use", 1, "/x", router("b.ts#r")), ("b.ts#r", "use", 2, "/again", router("b.ts#r")), ("b.ts#r", "GET", 3, "/y", fn("h")), ("d.ts#lost", "GET", 4, "/z", fn("h")), (None, "GET", 5, "/q", fn("h")),
        ("a.ts#app", "use", 6, "<dynamic>", router("e.ts#dyn")), ("e.ts#dyn", "GET", 7, "/in", fn("g")), ("a.ts#app", "GET", 8, "<dynamic>", fn("g")),
    ])
    assert set(out) == {"GET /x/y -> h", "GET /*/in -> g", "GET /* -> g"}
    assert [w.split(":")[0] for w in warnings] == ["a.ts", "b.ts", "d.ts", "odd.ts"]
    assert "never mounted" in warnings[2] and "skipped to avoid a loop" in warnings[1] and "thing.get(...)" in warnings[3]
    assert "shown as *" in more["GET /*"][0][0]


def test_handlers_left_of_a_router_are_inherited(spark):
    out, _, _ = shown(spark, [("a.ts#app", "use", 1, "/p", fn("left"), router("b.ts#r"), fn("right")), ("b.ts#r", "GET", 2, "/", fn("h")), ("a.ts#app", "GET", 3, "/p/own", fn("own"))])
    assert out == {"GET /p -> h": "app:left", "GET /p/own -> own": "app:left app:right"}


ROUTES = [(1, "POST", "/api/patients/enroll"), (2, "GET", "/api/patients/:id"), (3, "GET", "/api/patients/me"), (4, "ALL", "/api/health"), (5, "GET", "/api/health")]


def edges(spark, calls, table=ROUTES, pins=None):
    c = spark.createDataFrame([(i, m, u, f"w.ts#f{i}") for i, (m, u) in enumerate(calls)], "call_id int, method string, url_pattern string, caller string")
    r = spark.createDataFrame(table, "route_id int, method string, full_path string")
    p = spark.createDataFrame(pins, "caller string, method string, url string, route string, position int") if pins else None
    out = {}
    for e in routes.cross_edges(c, r, p).collect():
        out.setdefault(e.call_id, []).append((e.route_id, e.match, e.confidence, e.resolved))
    return [sorted(out.get(i, []), key=lambda e: (-e[2], e[0])) for i in range(len(calls))], (c, r, p)


def test_cross_edges(spark):
    got, _ = edges(spark, [("POST", "/api/patients/enroll"), ("GET", "/api/patients/:id"), ("GET", "/api/patients/me"), ("GET", "/api/health"), ("POST", "/patients/enroll"), ("UNKNOWN", "/api/patients/enroll"), ("DELETE", "/api/patients/:id"), ("GET", "")])
    assert got == [
        [(1, "exact", 1.0, True)], [(2, "exact", 1.0, True)], [(3, "exact", 1.0, True), (2, "param", 0.9, False)], [(5, "exact", 1.0, True), (4, "exact", 0.95, False)], [(1, "suffix", 0.6, False)],
        [(1, "method", 0.5, False), (2, "method", 0.5, False)], [], [],
    ]


def test_ties_wildcards_and_pins(spark):
    got, _ = edges(spark, [("POST", "/api/patients/enroll")], [*ROUTES, (6, "POST", "/api/patients/enroll")])
    assert [e[3] for e in got[0]] == [False, False]
    got, _ = edges(spark, [("GET", "/health"), ("GET", "/users/42")], [(7, "GET", "*"), (8, "GET", "/:code"), (9, "GET", "/api/health"), (10, "GET", "/api/users/:id")])
    assert got == [[(7, "wildcard", 0.6, False), (8, "wildcard", 0.6, False), (9, "suffix", 0.6, False)], [(10, "suffix", 0.6, False)]]
    pins = [("w.ts#f0", "POST", "/patients/enroll", "POST /api/patients/enroll", 0), ("w.ts#f1", "GET", "/api/health", "GET /gone", 1), ("w.ts#f9", "GET", "/none", "GET /gone", 2)]
    got, (c, r, p) = edges(spark, [("POST", "/patients/enroll"), ("GET", "/api/health")], pins=pins)
    assert got[0] == [(1, "pinned", 1.0, True)] and got[1][0] == (5, "exact", 1.0, True)
    assert [m.message for m in routes.pin_warnings(c, r, p).orderBy("position").collect()] == [
        "Pinned edge w.ts#f1 GET /api/health → GET /gone: no such route; the pin is ignored.",
        "Pinned edge w.ts#f9 GET /none → GET /gone: no such API call in the index; remove it from pinnedEdges.",
    ]


def test_requests(spark):
    table = spark.createDataFrame([*ROUTES, (6, "GET", "/api/patients/search")], "route_id int, method string, full_path string")
    asked = spark.createDataFrame([(1, "GET", "/api/patients/42"), (2, "GET", "/api/patients/search"), (3, "DELETE", "/api/health"), (4, "GET", "/nope")], "request_id int, method string, path string")
    got = {(r.request_id, r.route_id) for r in routes.match_requests(asked, table).collect()}
    assert got == {(1, 2), (2, 6), (3, 4)}
    near = {(r.request_id, r.position): (r.route_id, r.score) for r in routes.closest_routes(asked, table, 2).collect()}
    assert near[1, 1] == (2, 3.5) and near[4, 1][1] == 0.5


def fits(route, call, method, asked):
    """A plain version of how a call fits a route: the kind of match, None if it does not."""
    if asked not in ("UNKNOWN", method) and method != "ALL":
        return None
    have, want = ([x for x in p.split("/") if x] for p in (route, call))

    def compare(have, want):
        literal = False
        for h, w in zip(have, want, strict=True):
            opened = h == "*" or h.startswith(":")
            if not opened and (h != w or w.startswith(":")):
                return None
            literal |= not opened
        if "*" in have or (not literal and any(not w.startswith(":") for w in want)):
            return "wildcard"
        return "param" if any((h == "*" or h.startswith(":")) and not w.startswith(":") for h, w in zip(have, want, strict=True)) else "exact"

    if len(have) == len(want):
        return compare(have, want)
    if not want or len(have) < len(want):
        return None
    tail = have[len(have) - len(want) :]
    found = compare(tail, want)
    return "suffix" if found in ("exact", "param") and any(h == w and not h.startswith(":") for h, w in zip(tail, want, strict=True)) else None


def test_candidates_equal_every_pair_compared(spark):
    import random

    draw = random.Random(3)
    paths = lambda parts, n: ["/" + "/".join(draw.choice(parts) for _ in range(draw.randint(0, 4))) for _ in range(n)]
    table = [(i, draw.choice(["GET", "POST", "ALL"]), p) for i, p in enumerate(paths(["a", "b", ":id", ":x", "*"], 150))]
    calls = [(i, draw.choice(["GET", "POST", "DELETE", "UNKNOWN"]), p) for i, p in enumerate(paths(["a", "b", "c", ":p", "*"], 80))]
    r = spark.createDataFrame([*table, (900, "GET", None)], "route_id int, method string, full_path string")
    c = spark.createDataFrame([*calls, (900, "GET", None)], "call_id int, method string, url_pattern string")
    got = sorted((x.call_id, x.route_id, x.match) for x in routes.candidates(c, r).collect())
    want = sorted((i, j, "method" if a == "UNKNOWN" else k) for i, a, u in calls for j, m, p in table if (k := fits(p, u, m, a)))
    assert got == want and len(got) > 500
    concrete = [(i, m, u) for i, m, u in calls if m != "UNKNOWN"] + [(500, "GET", "/:"), (501, "GET", "/a/:/b")]
    asked = spark.createDataFrame([*concrete, (900, "GET", None)], "request_id int, method string, path string")
    best = {}
    for i, m, u in concrete:
        for j, rm, p in table:
            have, want = ([x for x in q.split("/") if x] for q in (p, u))
            if rm in (m, "ALL") and len(have) == len(want) and all(h == "*" or h.startswith(":") or h == w for h, w in zip(have, want, strict=True)):
                best.setdefault(i, []).append(((0 if p == u else 2) + (rm != m), j))
    expected = sorted((i, j, t) for i, found in best.items() for t, j in found if t == min(found)[0])
    assert sorted((x.request_id, x.route_id, x.tier) for x in routes.match_requests(asked, r).collect()) == expected


def test_keys_of_routes_with_parameters_at_their_ends(spark):
    """Two thousand routes that all end in a parameter share no join key, and have three forms for each length."""
    table = spark.range(2000).select(F.col("id").alias("route_id"), F.lit("GET").alias("method"), F.concat(F.lit("/api/thing"), "id", F.when(F.col("id") % 2 == 0, "/:id").otherwise("/sub/:id")).alias("full_path"))
    keys = routes.route_keys(table)
    assert keys.groupBy("key", "route_method").count().agg(F.max("count")).first()[0] == 1000  # "/sub/:id", a suffix that they do share
    assert keys.where(F.size("have") == F.col("n")).groupBy("key").count().agg(F.max("count")).first()[0] == 1
    assert keys.select("n", "form").distinct().count() <= 4
    calls = spark.createDataFrame([(1, "GET", "/api/thing7/sub/42"), (2, "GET", "/api/thing8/:x")], "call_id int, method string, url_pattern string")
    assert sorted((r.call_id, r.route_id, r.match) for r in routes.candidates(calls, table).collect()) == [(1, 7, "param"), (2, 8, "exact")]
