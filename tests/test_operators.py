import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import paths, sql_effects, text
from weftline.operators import freshness, graph, grounding, nesting, relational

SOME = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def value(spark, expression, kind="string", **columns):
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} {kind if not isinstance(v, list) else 'array<string>'}" for c, v in columns.items()))
    return frame.select(expression.alias("v")).first().v


@pytest.mark.parametrize(("a", "b", "out"), [("/", "/", "/"), ("/api", "/patients/", "/api/patients"), ("/api/", "x//y", "/api/x/y")])
def test_join_path(spark, a, b, out):
    assert value(spark, paths.join_path(F.col("a"), F.col("b")), a=a, b=b) == out


def test_paths(spark):
    assert value(spark, paths.url_pattern(F.col("u")), u="https://x.example.com/v1/items?page=1") == "/v1/items"
    assert value(spark, paths.template_pattern(F.col("p"), F.col("n")), p=["", "/patients/", ""], n=["API", "id"]) == "/patients/:id"
    assert value(spark, paths.template_pattern(F.col("p"), F.col("n")), p=["/a/", "/b?x=1"], n=["id"]) == "/a/:id/b"
    for target, method, path in (("post /api/patients/enroll/", "POST", "/api/patients/enroll"), ("GET /a?full=1", "GET", "/a"), ("  get   //api//x ", "GET", "/api/x"), ("FETCH /x", None, "/x"), ("GET x", "GET", None)):
        assert (value(spark, paths.request_method(F.col("t")), t=target), value(spark, paths.request_path(F.col("t")), t=target)) == (method, path)
    for spec, name in (("express", "express"), ("@a/b/c", "@a/b"), ("node:events", "node"), ("fs/promises", "node"), ("./x", None), ("lodash/fp", "lodash")):
        assert value(spark, paths.package_name(F.col("s")), s=spec) == name
    assert value(spark, paths.repository_slug(F.col("d")), d="/src/My-Repo/") == "wl_my_repo"
    assert value(spark, paths.repository_url(F.col("r")), r="git+https://github.com/a/b.git") == "https://github.com/a/b"
    assert value(spark, paths.repository_url(F.col("r")), r="github:a/b") == "https://github.com/a/b"
    assert value(spark, paths.target_symbol(F.col("t")), t="a/b.ts#f") == "f" and value(spark, paths.target_file(F.col("t")), t=".\\a\\b.ts#f") == "a/b.ts"
    assert tuple(value(spark, paths.target_range(F.col("t")), t="a.ts:3-9")) == (3, 9) and value(spark, paths.target_range(F.col("t")), t="a.ts:9-3") is None
    slug = value(spark, paths.document_slug(F.col("k"), F.col("r")), k="fn", r="a/b.ts#f")
    assert slug == f"fn--a_b.ts_f--{hashlib.sha256(b'fn:a/b.ts#f').hexdigest()[:8]}"


def test_text(spark):
    assert value(spark, text.split_lines(F.col("t")), t="a\r\nb\n") == ["a", "b"] and value(spark, text.split_lines(F.col("t")), t="") == [""]
    assert value(spark, text.code_spans(F.col("t")), t="use `a.b(c)` then `x < 18`") == ["a.b(c)", "x < 18"]
    assert value(spark, text.identifiers(F.col("t")), t=r"phone.replace(/\D/g, '') + 10") == ["phone", "replace", "g"]
    assert value(spark, text.estimate_tokens(F.col("t")), t="\U0001f600abc") == 2
    assert [value(spark, text.list_names(F.col("n")), n=n) for n in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b and c"]
    assert value(spark, text.one_line(F.col("t")), t="a \n b" + "x" * 100) == "a b" + "x" * 76 + "…"
    assert (value(spark, text.error_name(F.col("t")), t="ConflictError (409)"), value(spark, text.error_status(F.col("t")), t="ConflictError (409)")) == ("ConflictError", 409)
    assert value(spark, text.dropped_note(F.col("n")), n=["a:1", "b:2"]).startswith("2 references dropped")


SQL = [
    ("SELECT * FROM unnest($1::int[]) AS x JOIN patients p ON true", ["SELECT patients"]), ('UPDATE "public"."patients" SET a = 1 FROM consents WHERE x', ["UPDATE public.patients", "SELECT consents"]),
    ("INSERT INTO patients (id) VALUES ($1) ON CONFLICT (id) DO UPDATE SET id = $1", ["INSERT patients"]), ("SELECT * FROM jobs WHERE id = $1 FOR UPDATE SKIP LOCKED", ["SELECT jobs"]), ("SELECT * FROM jobs j FOR NO KEY UPDATE OF j", ["SELECT jobs"]),
    ("SELECT trim(both ' ' FROM name), extract(epoch FROM created_at) FROM patients", ["SELECT patients"]), ("WITH moved AS (DELETE FROM queue RETURNING *) INSERT INTO archive SELECT * FROM moved", ["DELETE queue", "INSERT archive"]),
    ("SELECT * FROM a WHERE id IN (SELECT a_id FROM b) AND exists(SELECT 1 FROM c)", ["SELECT a", "SELECT b", "SELECT c"]), ("BEGIN", []), ("  commit", []), ("", []), (None, []),
]


def test_sql_effects(spark):
    frame = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SQL)], "i int, s string").withColumn("e", sql_effects.sql_effects(F.col("s")))
    assert {r.i: [e.detail for e in r.e] for r in frame.collect()} == {i: out for i, (_, out) in enumerate(SQL)}
    assert all(e.kind == ("db_read" if e.detail.startswith("SELECT") else "db_write") for r in frame.collect() for e in r.e)


spans_ = st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30), st.integers(0, 8)), min_size=1, max_size=15)


def frames(spark, spans):
    return spark.createDataFrame([(i, k, a, a + n) for i, (k, a, n) in enumerate(spans)], "id int, k int, start int, end int")


@SOME
@given(spans_)
def test_merged_ranges_are_disjoint_and_cover(spark, spans):
    got = {}
    for r in relational.merge_ranges(frames(spark, spans), ["k"]).collect():
        got.setdefault(r.k, []).append((r.start, r.end))
    for k in {s[0] for s in spans}:
        points = {p for kk, a, n in spans if kk == k for p in range(a, a + n + 1)}
        assert {p for a, b in got[k] for p in range(a, b + 1)} == points
        ordered = sorted(got[k])
        assert all(x[1] + 1 < y[0] for x, y in zip(ordered, ordered[1:]))


@SOME
@given(spans_)
def test_interval_joins_equal_brute_force(spark, spans):
    f = frames(spark, spans)
    rows = [(i, k, a, a + n) for i, (k, a, n) in enumerate(spans)]
    got = sorted((r.l_id, r.r_id) for r in relational.overlap_join(f, f, ["k"], 5).collect())
    assert got == sorted((x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    top = sorted(r.id for r in relational.outermost(f, ["k"]).collect())
    assert top == [x[0] for x in rows if not any(y[1] == x[1] and y[2] <= x[2] and y[3] >= x[3] and (y[2] < x[2] or y[3] > x[3]) for y in rows)]


@SOME
@given(st.lists(st.integers(0, 300), min_size=1, max_size=12), st.integers(10, 120))
def test_budget_never_exceeds_its_limit_and_skips(spark, sizes, limit):
    f = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(sizes)], "g int, id int, text string")
    left, expected = limit, []
    for i, n in enumerate(sizes):
        cost = -(-n // 4) + 10
        if cost <= left:
            left -= cost
            expected.append(i)
    assert sorted(r.id for r in relational.greedy_budget(f, ["g"], ["id"], limit).collect()) == expected
    assert sorted(r.id for r in relational.greedy_budget(f, ["g"], ["id"], limit, block=2).collect()) == expected


def test_dependency_order(spark):
    cases = {
        "below": ({10: "main", 20: "helper"}, [(10, 20)], ["helper", "main"], []), "none": ({1: "a", 5: "b"}, [], ["a", "b"], []),
        "pair": ({1: "entry", 5: "ping", 9: "pong"}, [(1, 5), (5, 9), (9, 5)], ["ping", "pong", "entry"], ["ping and pong call each other; walked in source order"]),
        "two": ({1: "a", 2: "b", 3: "c", 4: "d"}, [(1, 2), (2, 1), (1, 3), (3, 4), (4, 3)], ["c", "d", "a", "b"], ["a and b call each other; walked in source order", "c and d call each other; walked in source order"]),
        "ring": ({1: "a", 2: "b", 3: "c"}, [(1, 2), (2, 3), (3, 1)], ["a", "b", "c"], ["a, b and c call each other; walked in source order"]),
    }
    functions = spark.createDataFrame([(f, n, s) for f, (names, *_) in cases.items() for s, n in names.items()], "file string, name string, start int")
    edges = spark.createDataFrame([(f, a, b) for f, (_, links, *_) in cases.items() for a, b in links], "file string, src int, dst int")
    rows = graph.dependency_order(functions, edges).orderBy("file", "position").collect()
    for f, (_, _, order, notes) in cases.items():
        assert [r.name for r in rows if r.file == f] == order
        assert sorted({r.cycle for r in rows if r.file == f and r.cycle}) == notes


def closure(start, out):
    seen, todo = set(), [start]
    while todo:
        for n in out[todo.pop()] - seen:
            seen.add(n)
            todo.append(n)
    return seen


@SOME
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=16))
def test_graph_searches_equal_brute_force(spark, links):
    edges = spark.createDataFrame(links, "src int, dst int")
    nodes = range(8)
    out = {n: {b for a, b in links if a == n} for n in nodes}
    full = {n: closure(n, out) for n in nodes}
    got = {(r.node, r.component) for r in graph.strong_components(edges).collect()}
    assert got == {(n, min(m for m in nodes if m == n or (m in full[n] and n in full[m]))) for n in nodes if any(m != n and m in full[n] and n in full[m] for m in nodes)}
    roots = spark.createDataFrame([(0,), (1,)], "r int")
    two, three = ({(r.root, r.node, r.depth) for r in graph.reach(edges, roots, d).collect()} for d in (2, 3))
    assert two <= three
    level, seen = {0}, {}
    for d in (1, 2, 3):
        level = {b for n in level for b in out[n]} - set(seen)
        seen |= {n: d for n in level}
    assert {(n, d) for r, n, d in three if r == 0} == set(seen.items())
    for r in graph.shortest_paths(edges, roots, 4).collect():
        assert all(b in out[a] for a, b in zip(r.path, r.path[1:])) and r.path[0] == r.root and r.path[-1] == r.node


def test_verification(spark):
    step = lambda i, file, a, b, words="", refs=(), docs=(): {"id": i, "code_ref": {"file": file, "start": a, "end": b}, "explanation": words, "references": [{"file": f, "line": n, "role": "r"} for f, n in refs], "docs": [{"package": p, "symbol": "s"} for p in docs]}
    good = step("ok", "s.ts", 3, 6, "calls `enroll` and `handle`", [("c.ts", 5)], ["express", "lodash"])
    bad = [step("far", "s.ts", 9, 42), step("lost", "x.ts", 1, 1), step("ref", "s.ts", 3, 3, refs=[("c.ts", 6)]), step("name", "s.ts", 3, 3, "uses `validatePhoneNumber(x)`")]
    w = spark.createDataFrame([("w", {"title": "t", "summary": "", "stages": [{"name": "one", "steps": [good, bad[0]]}, {"name": "two", "steps": bad[1:]}], "unresolved": []})], f"scope string, walkthrough {grounding.WALKTHROUGH}")
    files = spark.createDataFrame([("w", "s.ts", 10), ("w", "c.ts", 5)], "scope string, file string, line_count int")
    words = grounding.vocabulary(spark.createDataFrame([("w", "function enroll(x) { handle() }")], "scope string, text string"))
    done, dropped, removed = grounding.verify(w, files, words, spark.createDataFrame([("w", "express")], "scope string, package string"))
    kept = done.first().walkthrough
    assert [(s.name, [x.id for x in s.steps]) for s in kept.stages] == [("one", ["ok"])] and [d.package for d in kept.stages[0].steps[0].docs] == ["express"]
    assert {r.step_id: r.reasons[0] for r in dropped.collect()} == {
        "far": "code_ref s.ts:9-42 is outside the file's lines 1-10", "lost": "code_ref cites x.ts, which is not part of the indexed context", "ref": "reference c.ts:6 is outside the file's lines 1-5",
        "name": "explanation names identifiers not found in the code or index: `validatePhoneNumber`",
    }
    assert [(r.step_id, r.package) for r in removed.collect()] == [("ok", "lodash")]
    answers = spark.createDataFrame([("w", 1, "see `enroll` and `nope`", [("s.ts", 2, "r"), ("s.ts", 20, "r"), ("z.ts", 1, "r")])], "scope string, question_id int, answer string, references array<struct<file:string,line:int,role:string>>")
    (row,) = grounding.check_answers(answers, files, words).collect()
    assert [(r.file, r.line) for r in row.references] == [("s.ts", 2)] and len(row.warnings) == 3 and row.warnings[2].endswith("`nope`")
    stub = grounding.line_stub(spark.createDataFrame([("w", "s.ts", 3, 6)], "scope string, file string, start int, end int"))
    assert [s.code_ref.start for s in stub.first().walkthrough.stages[0].steps] == [3, 4, 5, 6]


LINES = ["function helper() {", "  return 1", "}", "", "function main() {", "  const a = helper()", "  return a", "}"]


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize(
    ("lines", "at", "state", "fresh", "starts"),
    [
        (LINES, (5, 8), "fresh", [1, 1, 1, 1], [5, 6, 7, 8]), (["// one", "// two", *LINES], (7, 10), "fresh", [1, 1, 1, 1], [7, 8, 9, 10]), ([*LINES[:5], "  const a = other()", *LINES[6:]], (5, 8), "changed", [1, 0, 1, 1], [5, 6, 7, 8]),
        ([*LINES[:6], "  log(a)", *LINES[6:]], (5, 9), "changed", [1, 1, 1, 1], [5, 6, 8, 9]), (LINES[:4], None, "missing", [0, 0, 0, 0], [5, 6, 7, 8]),
    ],
)
def test_sections(spark, lines, at, state, fresh, starts):
    section = spark.createDataFrame([(1, "f.ts", "main", 5, 8, sha(LINES[4:]))], "section_id int, file string, symbol string, start int, end int, hash string")
    steps = spark.createDataFrame([(1, f"s{i}", "f.ts", i, i, sha(LINES[i - 1 : i])) for i in range(5, 9)], "section_id int, step_id string, step_file string, step_start int, step_end int, step_hash string")
    source = spark.createDataFrame([("f.ts", lines)], "file string, lines array<string>")
    symbols = spark.createDataFrame([("f.ts", "main", *at)] if at else [], "file string, name string, start_line int, end_line int")
    sections, judged = freshness.check_sections(section, steps, source, symbols)
    assert sections.first().state == state
    assert [(int(r.fresh), r.start) for r in sorted(judged.collect(), key=lambda r: r.step_id)] == list(zip(fresh, starts))


def test_blocks_without_symbol_follow_their_text(spark):
    blocks = spark.createDataFrame([(1, 0, "f.ts", None, 2, 3, sha(["b", "c"])), (2, 0, "f.ts", None, 90, 91, sha(["gone", "x"])), (3, 0, "none.ts", None, 1, 1, "h")], "section_id int, position int, file string, symbol string, start int, end int, hash string")
    steps = spark.createDataFrame([(1, "s", "f.ts", 3, 3, sha(["c"])), (2, "s", "f.ts", 90, 90, "h"), (3, "s", "none.ts", 1, 1, "h")], "section_id int, step_id string, step_file string, step_start int, step_end int, step_hash string")
    source = spark.createDataFrame([("f.ts", ["new", "a", "b", "c"])], "file string, lines array<string>")
    none = spark.createDataFrame([], "file string, name string, start_line int, end_line int")
    sections, judged = freshness.check_block_sections(blocks, steps, source, none)
    assert {r.section_id: (r.state, r["at"] and r["at"].start) for r in sections.collect()} == {1: ("fresh", 3), 2: ("missing", None), 3: ("missing", None)}
    assert {r.section_id: (r.fresh, r.start) for r in judged.collect()} == {1: (True, 4), 2: (False, 90), 3: (False, 1)}


def test_whole_walkthroughs_and_reuse(spark):
    saved = spark.createDataFrame([("f", "file", "f.ts", None), ("g", "file", "g.ts", None), ("e", "endpoint", None, "h1"), ("c", "component", None, "h2"), ("t", "trace", None, "h3")], "scope string, kind string, file string, chain_hash string")
    sections = spark.createDataFrame([(s, "fresh") for s in "fgec"] + [("t", "changed")], "scope string, state string")
    steps = spark.createDataFrame([("f", True), ("t", False), ("t", True)], "scope string, fresh boolean")
    symbols = spark.createDataFrame([("f.ts", "main", "function", 1, 5), ("f.ts", "inner", "function", 2, 3), ("f.ts", "T", "type", 7, 8)], "file string, name string, kind string, start_line int, end_line int")
    missing = freshness.uncovered(saved.where("kind = 'file'").select("scope", "file"), spark.createDataFrame([], "scope string, name string"), symbols)
    files = spark.createDataFrame([("f.ts",)], "path string")
    current = spark.createDataFrame([("e", "h1"), ("c", "other"), ("t", None)], "scope string, hash string")
    got = {r.scope: r for r in freshness.check_walkthroughs(saved, sections, steps, missing, files, current).collect()}
    assert {s: r.fresh for s, r in got.items()} == {"f": False, "g": False, "e": True, "c": False, "t": False}
    assert got["f"].uncovered == ["main"] and got["g"].file_removed and got["c"].chain_changed and got["t"].route_removed and (got["t"].stale_steps, got["t"].total_steps) == (1, 2)
    section = spark.createDataFrame([(1, "f.ts", 5, 8, "h", 2), (2, "f.ts", 5, 8, "old", 2)], "section_id int, file string, start int, end int, hash string, depth int")
    own = spark.createDataFrame([(1, "f.ts", 6, 7)], "section_id int, step_file string, step_start int, step_end int")
    refs = spark.createDataFrame([(1, "f.ts", 6, "x", "a"), (1, "o.ts", 2, "call()", "old"), (1, "o.ts", 3, "}", "old"), (1, "same.ts", 9, "k", "a")], "section_id int, file string, line int, text string, file_hash string")
    sources = spark.createDataFrame([("f.ts", "a", ["z"]), ("o.ts", "new", ["", "", "", "call()"]), ("same.ts", "a", [])], "file string, hash string, lines array<string>")
    now = spark.createDataFrame([(1, 10, "h"), (2, 10, "h")], "section_id int, new_start int, new_hash string")
    (kept,) = freshness.reuse_sections(section, own, refs, now, sources, 2).collect()
    assert (kept.section_id, kept.delta) == (1, 5) and kept.note == "1 reference dropped because the code it pointed to changed: o.ts:3"
    moved = freshness.relocate_references(refs, now.where("section_id = 1").join(section, "section_id").select("section_id", "file", "start", "end", "new_start"), sources)
    assert sorted((r.file, r.line, r.now) for r in moved.collect()) == [("f.ts", 6, 11), ("o.ts", 2, 4), ("o.ts", 3, None), ("same.ts", 9, 9)]


def test_sweeps_and_cells_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    spans = [(i, "k" if i % 3 else "hot", s := rng.randrange(-50, 900), s + rng.choice([0, 1, 5, 60, 700]), ) for i in range(300)]
    points = [(i, rng.choice(["k", "hot", "none"]), rng.randrange(-60, 1000)) for i in range(200)]
    got = nesting.holding(spark.createDataFrame(points, "id long, k string, at long"), spark.createDataFrame(spans, "id long, k string, start long, `end` long"), ["k"])
    expected = {}
    for i, k, at in points:
        around = [(-s, e, j) for j, own, s, e in spans if own == k and s <= at <= e]
        if around:
            expected[i] = min(around)[2]
    assert {r.id: r.span_id for r in got.collect()} == expected
    lines = [(k, n) for _, k, n in points for _ in range(2)]
    asked = [(i, k, rng.randrange(-100, 1100)) for i, (_, k, _) in enumerate(points)] + [(999, "absent", 3)]
    got = relational.nearest_match(spark.createDataFrame(asked, "id long, k string, near long"), spark.createDataFrame(lines, "k string, line long"), ["k"])
    expected = {i: min((abs(n - near), n) for own, n in lines if own == k)[1] for i, k, near in asked if k != "absent"}
    assert {r.id: r.line for r in got.collect()} == expected
    empty = spark.createDataFrame([], "id long, k string, start long, `end` long")
    assert nesting.holding(spark.createDataFrame(points, "id long, k string, at long"), empty, ["k"]).collect() == []


def test_numbers_over_all_rows(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "n long").repartition(5)
    assert [(r.n, r.id) for r in relational.number_all(rows, ["n"], 10).orderBy("n").collect()] == [(i, i + 11) for i in range(101)]
    assert relational.number_all(rows.limit(0), ["n"]).collect() == []


def test_sql_effects_of_brackets_and_names():
    from weftline.functions.sql_effects import effects

    said = lambda sql: [e["detail"] for e in effects(sql)]
    assert said('DELETE FROM "Shop".items USING x WHERE trim(both FROM name) = 1') == ["DELETE Shop.items"]
    assert said("SELECT * FROM (SELECT 1 FROM a) q JOIN generate_series(1, 2) g ON true JOIN LATERAL (VALUES (1)) v ON true") == ["SELECT a"]
    assert said("select count(( select max(x) from deep )) from top for update") == ["SELECT deep", "SELECT top"]
    assert said("WITH RECURSIVE t(n) AS (SELECT 1), u AS MATERIALIZED (SELECT * FROM b) INSERT INTO c SELECT * FROM u, d") == ["SELECT b", "INSERT c"]
    assert said("UPDATE ONLY x SET a = 1") == [] and said(")) FROM a (") == [] and said("FROM") == [] and said("") == []
    assert said("x" * 10 + " FROM a" * 20000) == ["SELECT a"]


def test_order_of_a_long_file():
    from weftline.operators.graph import _ordered

    n = 20000
    chain = _ordered({i: f"f{i}" for i in range(n)}, [(i, i + 1) for i in range(n - 1)])
    assert [s for s, _ in chain] == list(range(n - 1, -1, -1))
    ring = _ordered({i: f"f{i}" for i in range(5)}, [(0, 1), (1, 0), (2, 0), (3, 4), (4, 3), (1, 3)])
    assert [s for s, _ in ring] == [3, 4, 0, 1, 2] and ring[0][1].startswith("f3 and f4 call each other") and ring[4][1] is None
