import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import freshness, grounding, prompts, regeneration


def written(line, name="main", file="f.ts"):
    step = {"id": "s", "code_ref": {"file": file, "start": line, "end": line}, "explanation": f"calls `{name}`", "references": [{"file": file, "line": line, "role": "callee"}], "docs": []}
    return {"title": "t", "summary": "", "stages": [{"name": "a", "steps": [step]}], "unresolved": []}


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def facts(spark):
    scopes = ["a", "b", "c", "d", "x"]
    files = table(spark, [(s, "f.ts", 9) for s in scopes], "scope string, file string, line_count int")
    words = grounding.vocabulary(table(spark, [(s, "main()") for s in scopes], "scope string, text string"))
    return files, words, table(spark, [], "scope string, package string")


ORDER = [("f.ts", 0, "a", "a"), ("f.ts", 1, "b", "b"), ("f.ts", 2, "c", "c"), ("f.ts", 3, "d", "d"), ("g.ts", 0, "x", "x")]


def run(spark, facts, provider, kept, refresh=False, errors=None):
    order = table(spark, ORDER, "file string, position int, symbol string, scope string")
    prompt_rows = [(s, None if s in (errors or {}) else f"explain {s}", (errors or {}).get(s)) for *_, s in ORDER]
    have = grounding.parse_walkthroughs(table(spark, [(s, json.dumps(written(1))) for s in kept], "scope string, json string"))
    sections, failed = regeneration.regenerate(order, have, table(spark, prompt_rows, "scope string, prompt string, error string"), provider, *facts, refresh=refresh)
    return {r.scope: r.origin for r in sections.collect()}, {r.scope: r.reason for r in failed.collect()}


def test_only_what_is_not_kept_is_asked_for(spark, facts):
    good = json.dumps(written(2))

    def provider(prompt, complaints):
        if prompt in ("explain a", "explain x"):
            raise AssertionError("kept sections are not asked for")
        return good if complaints or prompt != "explain b" else "{"

    assert run(spark, facts, provider, ["a", "x"]) == ({"a": "reused", "b": "generated", "c": "generated", "d": "generated", "x": "reused"}, {})


def test_a_failed_request_ends_its_file_and_keeps_sections(spark, facts):
    good = json.dumps(written(2))

    def provider(prompt, complaints):
        if prompt == "explain b":
            raise ConnectionError("rate limit")
        return good

    got = run(spark, facts, provider, ["b", "c"], refresh=True)
    assert got == ({"a": "generated", "b": "reused", "c": "reused", "x": "generated"}, {"d": "skipped after an earlier error"})


def test_unusable_output_and_targets(spark, facts):
    good, answers = json.dumps(written(3)), {"explain a": json.dumps(written(99)), "explain c": json.dumps(written(2, "other")), "explain d": "not json"}

    def provider(prompt, complaints):
        return answers.get(prompt, good)

    sections, failed = run(spark, facts, provider, [], errors={"b": "no such symbol"})
    assert sections == {"x": "generated"}
    assert failed == {"a": "no step could be verified", "b": "no such symbol", "c": "no step could be verified", "d": "no valid output after 3 attempts"}
    empty = run(spark, facts, provider, ["a", "b", "c", "d", "x"])
    assert set(empty[0].values()) == {"reused"} and empty[1] == {}


def test_moved_sections(spark):
    saved = written(2)
    saved["stages"][0]["steps"][0]["references"] += [{"file": "g.ts", "line": 1, "role": "caller"}, {"file": "g.ts", "line": 2, "role": "caller"}]
    sections = grounding.parse_walkthroughs(table(spark, [("k", json.dumps(saved)), ("gone", json.dumps(saved))], "scope string, json string")).withColumnRenamed("scope", "section_id")
    rows = sections.select("section_id", F.lit("f.ts").alias("file"), F.lit(2).alias("start"), F.lit(3).alias("end"), F.lit("h").alias("hash"), F.lit(2).alias("depth"))
    steps = rows.select("section_id", F.lit("f.ts").alias("step_file"), F.lit(2).alias("step_start"), F.lit(2).alias("step_end"))
    refs = table(spark, [("k", "f.ts", 2, "x", "old"), ("k", "g.ts", 1, "callTheFunction(a)", "old"), ("k", "g.ts", 2, "lost(b)", "old")], "section_id string, file string, line int, text string, file_hash string")
    current = table(spark, [("k", 5, "h"), ("gone", 5, "other")], "section_id string, new_start int, new_hash string")
    sources = table(spark, [("f.ts", "new", ["a"] * 9), ("g.ts", "new", ["", "", "callTheFunction(a)"])], "file string, hash string, lines array<string>")
    reused = freshness.reuse_sections(rows, steps, refs, current, sources, 2)
    moved = freshness.relocate_references(refs, rows.join(current, "section_id"), sources)
    (row,) = regeneration.move(sections, reused, moved).collect()
    step = row.walkthrough.stages[0].steps[0]
    assert (row.section_id, step.code_ref.start, step.code_ref.end) == ("k", 5, 5)
    assert [(r.file, r.line) for r in step.references] == [("f.ts", 5), ("g.ts", 3)]
    assert row.walkthrough.unresolved == ["1 reference dropped because the code it pointed to changed: g.ts:2"]


def test_questions(spark):
    def provider(prompt, complaints):
        if "three" in prompt:
            return "no json"
        shown = all(x in prompt for x in ("# Facts\n\nthe facts\n\n# Step", "Step s at f.ts:2-3", "2 | two\n3 | drei", "because")) and "Write" not in prompt
        return json.dumps({"answer": f"`main` and `unheard`: {shown}", "references": [{"file": "f.ts", "line": 1, "role": "callee"}, {"file": "f.ts", "line": 77, "role": "type"}]})

    asked = [(1, "  why? \n", "s"), (2, " ", "s"), (3, "x" * 2001, "s"), (4, "why", "nope"), (5, "why", "old"), (6, "three", "s"), (7, None, "s")]
    questions = table(spark, [(i, "fn", "w", s, q) for i, q, s in asked], "question_id long, kind string, scope string, step_id string, question string")
    steps = table(spark, [("w", "s", "w", "because", "h"), ("w", "old", "w", "", "h")], "scope string, step_id string, facts string, explanation string, hash string")
    judged = table(spark, [("w", "s", True, "f.ts", 2, 3), ("w", "old", False, None, None, None)], "scope string, step_id string, fresh boolean, file string, start int, end int")
    lines = table(spark, [("f.ts", ["one", "two", "drei"])], "file string, lines array<string>")
    words = grounding.vocabulary(table(spark, [("w", "main()")], "scope string, text string"))
    files = table(spark, [("w", "f.ts", 3)], "scope string, file string, line_count int")
    answered, refused = regeneration.answer(questions, steps, judged, table(spark, [("w", "the facts\n\nWrite it.")], "scope string, prompt string"), lines, provider, files, words)
    (row,) = answered.collect()
    assert (row.question_id, row.question, row.answer, row.step_hash) == (1, "why?", "`main` and `unheard`: True", "h")
    assert [r.line for r in row.references] == [1] and len(row.warnings) == 2
    why = {r.question_id: r.reason for r in refused.collect()}
    assert set(why) == {2, 3, 4, 5, 6, 7} and why[2] == why[7] == "Ask a question first." and why[4] == 'No step "nope" in the fn walkthrough w.' and why[6] == "no valid output after 3 attempts"


def test_facts_of(spark):
    rows = [("a\n\nWrite b\n\nWrite c.", "a\n\nWrite b"), ("plain", "plain"), (None, None)]
    got = table(spark, rows, "p string, want string").select(prompts.facts_of(F.col("p")).alias("v"), "want").collect()
    assert all(r.v == r.want for r in got)
