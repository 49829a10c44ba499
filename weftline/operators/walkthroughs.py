"""Making and keeping walkthroughs: sections, scopes, providers, lists and details."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_lines, hash_lines
from . import graph, grounding, relational
from .windows import block_print

RETRIES = 2
PRIORITY = ["registration", "component", "hook", "target", "chain", "callee"]


class OutputError(ValueError):
    """A provider whose output never fitted the schema."""


class NoVerifiedSteps(ValueError):
    """An explanation of which nothing could be verified."""


def fn_scope(file: Column, symbol: Column, start: Column, end: Column) -> Column:
    """The scope of a function target: by name, else by lines."""
    lines = F.concat(file, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(symbol.isNotNull(), F.concat_ws("#", file, symbol)).otherwise(lines)


def scope_blocks(code: DataFrame) -> DataFrame:
    """(target, position, file, start, end, key, hash): the blocks that a context shows, each place once, by the priority of their parts."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("part"))
    shown = code.where("fits").where(F.col("part").isin(PRIORITY)).withColumn("_order", F.struct(rank.alias("p"), F.col("rank").alias("r")))
    first = relational.first_value(shown.withColumn("stop", F.col("shown_end")), ["target", "file", "start", "stop"], F.col("_order"), ["_order", "key", "code"])
    placed = relational.number_rows(first, ["target"], ["_order", "file", "start"])
    return placed.select("target", "position", "file", "start", F.col("stop").alias("end"), "key", hash_lines(F.col("code")).alias("hash"))


def record_sections(walkthroughs: DataFrame, lines: DataFrame) -> DataFrame:
    """(scope, step_hashes, step_prints, file_hashes, ref_lines): what freshness needs to know of new walkthroughs (scope, walkthrough) later.

    Maps from step to the digest and to the fingerprint of its lines, from file to its hash, and from
    "file:line" to the text of each reference.
    """
    steps = grounding.steps_of(walkthroughs)
    source = lines.select("file", "lines", F.col("hash").alias("_hash"))
    code = steps.select("scope", F.col("step.id").alias("id"), "step.code_ref.file", "step.code_ref.start", "step.code_ref.end").join(source, "file")
    code = code.withColumn("_block", block_lines(F.col("lines"), F.col("start"), F.col("end")))
    hashes = code.select("scope", F.struct("id", hash_lines(F.col("_block")).alias("v")).alias("e"))
    prints = code.select("scope", F.struct("id", block_print(F.col("_block")).alias("v")).alias("e"))
    refs = steps.select("scope", F.explode("step.references").alias("r")).select("scope", "r.file", "r.line").join(source, "file")
    texts = refs.where("line between 1 and size(lines)").select("scope", F.struct(F.concat_ws(":", "file", F.col("line").cast("string")), F.get("lines", F.col("line") - 1)).alias("e"))
    files = code.select("scope", F.struct("file", "_hash").alias("e")).unionByName(refs.select("scope", F.struct("file", "_hash").alias("e")))
    to_map = lambda rows, name: rows.groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_set("e"))).alias(name))
    return to_map(hashes, "step_hashes").join(to_map(prints, "step_prints"), "scope").join(to_map(files, "file_hashes"), "scope", "full_outer").join(to_map(texts, "ref_lines"), "scope", "full_outer")


def current_hashes(saved: DataFrame, endpoints: DataFrame, components: DataFrame, traces: DataFrame) -> DataFrame:
    """(scope, hash) for saved scopes (scope, kind) of structural kinds: today's digest, null for what is gone; others are not judged.

    The three tables have scope and hash.
    """
    every = endpoints.withColumn("kind", F.lit("endpoint")).unionByName(components.withColumn("kind", F.lit("component"))).unionByName(traces.withColumn("kind", F.lit("trace")))
    return saved.where(F.col("kind").isin("endpoint", "component", "trace")).select("scope", "kind").join(every, ["scope", "kind"], "left").select("scope", "hash")


def pins_for(loose: DataFrame, routes: DataFrame) -> DataFrame:
    """(caller, method, url, route): the pins that would tie loose edges (caller_id, call_method, url_pattern, route) to their routes."""
    shown = routes.select("route", F.concat_ws(" ", "method", "full_path").alias("_shown"))
    return loose.join(shown, "route").select(F.regexp_replace("caller_id", "@[0-9]+$", "").alias("caller"), F.col("call_method").alias("method"), F.col("url_pattern").alias("url"), F.col("_shown").alias("route"))


def frontend_calls(calls: DataFrame, root: str | None) -> DataFrame:
    """API calls (file, ...) under the frontend's root; without one all."""
    base = (root or "").replace("\\", "/").removeprefix("./").strip("/")
    return calls if base in ("", ".") else calls.where(F.startswith("file", F.lit(f"{base}/")))


def call_tree(callees: DataFrame) -> DataFrame:
    """(target, path, depth, callee_text, call_line, resolved) of calls as a tree for display: ``path`` sorts rows under their caller."""
    rows = callees.withColumn("_place", F.struct("call_line", "callee_text"))
    now = rows.where("depth = 1").select("target", F.array("_place").alias("path"), F.array("caller_id", "callee_id").alias("_seen"), "callee_id", "callee_text", "call_line", "resolved")
    out = now
    while True:
        step = rows.where("depth > 1").select("target", F.col("caller_id").alias("callee_id"), "_place", F.col("callee_id").alias("_to"), F.col("callee_text").alias("_text"), F.col("call_line").alias("_line"), F.col("resolved").alias("_ok"))
        joined = now.join(step, ["target", "callee_id"]).where("_to is null or not array_contains(_seen, _to)")
        now = graph.settle(joined.select("target", F.concat("path", F.array("_place")).alias("path"), F.concat("_seen", F.array("_to")).alias("_seen"), F.col("_to").alias("callee_id"), F.col("_text").alias("callee_text"), F.col("_line").alias("call_line"), F.col("_ok").alias("resolved")))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out.select("target", "path", F.size("path").alias("depth"), "callee_text", "call_line", "resolved")


def list_view(saved: DataFrame, status: DataFrame) -> DataFrame:
    """(scope, kind, title, saved_at, fresh, stale_steps, total_steps): saved walkthroughs with their state."""
    return saved.select("scope", "kind", "title", F.col("created_at").alias("saved_at")).join(status.select("scope", "fresh", "stale_steps", "total_steps"), "scope")


def detail_view(walkthroughs: DataFrame, judged: DataFrame, questions: DataFrame, outdated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of walkthroughs with where they are now, and questions with whether they are stale.

    ``judged`` has scope, step_id, fresh, file, start, end; ``outdated`` question_id and outdated.
    """
    steps = grounding.steps_of(walkthroughs).select("scope", "stage_at", "step_at", "stage", F.col("step.id").alias("step_id"), "step").join(judged, ["scope", "step_id"], "left")
    asked = questions.join(outdated, "question_id").join(judged.select("scope", "step_id", F.col("fresh").alias("_fresh")), ["scope", "step_id"], "left")
    return steps, asked.withColumn("stale", F.col("outdated") | ~F.coalesce("_fresh", F.lit(False))).drop("_fresh", "outdated")


def generate(spark, provider: Callable[[str, list[str]], str], prompts: dict[str, str]) -> DataFrame:
    """(scope, walkthrough) from a provider of JSON text, asked again up to RETRIES times with what was wrong; OutputError if it never fits.

    The provider is called on the driver with a prompt and the complaints so far.
    """
    done, left, wrong = {}, dict(prompts), {s: [] for s in prompts}
    for _ in range(RETRIES + 1):
        answers = {s: provider(p, wrong[s]) for s, p in left.items()}
        parsed = grounding.parse_walkthroughs(spark.createDataFrame(list(answers.items()), "scope string, json string"))
        good = {r.scope for r in parsed.where("walkthrough.title is not null and walkthrough.stages is not null").collect()}
        done |= {s: answers[s] for s in good}
        left = {s: p for s, p in left.items() if s not in good}
        for s in left:
            wrong[s].append("the output does not fit the schema")
        if not left:
            break
    if left:
        raise OutputError(f"no valid output for {', '.join(sorted(left))} after {RETRIES + 1} attempts")
    return grounding.parse_walkthroughs(spark.createDataFrame(list(done.items()), "scope string, json string"))


def explain(spark, provider: Callable[[str, list[str]], str], prompts: dict[str, str], files: DataFrame, words: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Generate, then keep what can be verified; NoVerifiedSteps if a scope keeps nothing."""
    done, dropped, removed = grounding.verify(generate(spark, provider, prompts), files, words, packages)
    empty = [r.scope for r in done.where(F.size("walkthrough.stages") == 0).select("scope").collect()]
    if empty:
        raise NoVerifiedSteps(f"no step could be verified for {', '.join(sorted(empty))}")
    return done, dropped, removed
