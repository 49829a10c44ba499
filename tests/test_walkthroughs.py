import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import grounding, walkthroughs

GOOD = {"title": "t", "summary": "", "stages": [{"name": "a", "steps": [{"id": "s", "code_ref": {"file": "f.ts", "start": 1, "end": 2}, "explanation": "uses `main`", "references": [{"file": "f.ts", "line": 2, "role": "r"}], "docs": []}]}], "unresolved": []}


@pytest.fixture
def facts(spark):
    files = spark.createDataFrame([("w", "f.ts", 3)], "scope string, file string, line_count int")
    return files, grounding.vocabulary(spark.createDataFrame([("w", "main()")], "scope string, text string")), spark.createDataFrame([], "scope string, package string")


def test_generation_retries_and_verifies(spark, facts):
    asked = []

    def provider(prompt, complaints):
        asked.append(len(complaints))
        return json.dumps(GOOD) if complaints else "not json"

    done, dropped, _ = walkthroughs.explain(spark, provider, {"w": "p"}, *facts)
    assert asked == [0, 1] and dropped.count() == 0 and done.first().walkthrough.stages[0].steps[0].id == "s"
    with pytest.raises(walkthroughs.OutputError):
        walkthroughs.generate(spark, lambda p, c: "{", {"w": "p"})
    far = json.loads(json.dumps(GOOD))
    far["stages"][0]["steps"][0]["code_ref"]["end"] = 99
    with pytest.raises(walkthroughs.NoVerifiedSteps):
        walkthroughs.explain(spark, lambda p, c: json.dumps(far), {"w": "p"}, *facts)


def test_sections_views_and_pins(spark):
    w = grounding.parse_walkthroughs(spark.createDataFrame([("w", json.dumps(GOOD))], "scope string, json string"))
    lines = spark.createDataFrame([("f.ts", ["a", "b", "c"], "h")], "file string, lines array<string>, hash string")
    (row,) = walkthroughs.record_sections(w, lines).collect()
    assert row.file_hashes == {"f.ts": "h"} and row.ref_lines == {"f.ts:2": "b"} and set(row.step_hashes) == {"s"}
    judged = spark.createDataFrame([("w", "s", True, "f.ts", 1, 2)], "scope string, step_id string, fresh boolean, file string, start int, end int")
    questions = spark.createDataFrame([(1, "w", "s"), (2, "w", "gone")], "question_id int, scope string, step_id string")
    steps, asked = walkthroughs.detail_view(w, judged, questions, questions.select("question_id", F.lit(False).alias("outdated")))
    assert steps.first().fresh and {r.question_id: r.stale for r in asked.collect()} == {1: False, 2: True}
    saved = spark.createDataFrame([("a", "endpoint"), ("b", "component"), ("c", "fn")], "scope string, kind string")
    table = lambda *rows: spark.createDataFrame(list(rows), "scope string, hash string")
    assert {r.scope: r.hash for r in walkthroughs.current_hashes(saved, table(("a", "h")), table(), table()).collect()} == {"a": "h", "b": None}
    loose = spark.createDataFrame([("w.ts#f@3", "GET", "/x", "r1")], "caller_id string, call_method string, url_pattern string, route string")
    routes = spark.createDataFrame([("r1", "GET", "/api/x")], "route string, method string, full_path string")
    assert tuple(walkthroughs.pins_for(loose, routes).first()) == ("w.ts#f", "GET", "/x", "GET /api/x")
    calls = spark.createDataFrame([("web/a.ts",), ("webs/b.ts",)], "file string")
    assert walkthroughs.frontend_calls(calls, "./web/").count() == 1 and walkthroughs.frontend_calls(calls, None).count() == 2


def test_call_tree(spark):
    rows = [("t", 1, "a", "b", "b()", 1, True), ("t", 1, "a", None, "x()", 2, False), ("t", 2, "b", "c", "c()", 9, True), ("t", 3, "c", "b", "b()", 4, True)]
    callees = spark.createDataFrame(rows, "target string, depth int, caller_id string, callee_id string, callee_text string, call_line int, resolved boolean")
    tree = walkthroughs.call_tree(callees).orderBy("path").collect()
    assert [(r.depth, r.callee_text) for r in tree] == [(1, "b()"), (2, "c()"), (1, "x()")]


def test_scope_blocks(spark):
    rows = [("t", "callee", "3", "c", "f.ts", 1, 2, ["a", "b"], True), ("t", "target", "0", "t", "f.ts", 1, 2, ["a", "b"], True), ("t", "hook", "1", "h", "g.ts", 5, 6, ["x"], True), ("t", "hook", "2", "h", "g.ts", 9, 9, ["x"], False)]
    code = spark.createDataFrame(rows, "target string, part string, rank string, key string, file string, start int, shown_end int, code array<string>, fits boolean")
    got = [(r.position, r.file, r.start, r.key) for r in walkthroughs.scope_blocks(code).orderBy("position").collect()]
    assert got == [(0, "g.ts", 5, "h"), (1, "f.ts", 1, "t")]
    frame = spark.createDataFrame([("f.ts", "g", 1, 2), ("f.ts", None, 1, 2)], "f string, s string, a int, b int")
    assert [r.v for r in frame.select(walkthroughs.fn_scope(*map(F.col, "fsab")).alias("v")).collect()] == ["f.ts#g", "f.ts:1-2"]
