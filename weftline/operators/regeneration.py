"""Walkthroughs made anew function by function, and answers to questions about their steps."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import block_lines
from . import graph, grounding, prompts
from .walkthroughs import RETRIES

Provider = Callable[[str, list[str]], str]
MOST_QUESTION = 2000
WALKTHROUGH_FORM, ANSWER_FORM = {"title": str, "stages": list}, {"answer": str, "references": list}
ANSWER = "struct<answer:string,references:array<struct<file:string,line:int,role:string>>>"


def _fits(text: str, form: dict[str, type]) -> bool:
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return False
    return isinstance(value, dict) and all(isinstance(value.get(name), kind) for name, kind in form.items())


def ask(rows: DataFrame, provider: Provider, form: dict[str, type]) -> DataFrame:
    """(scope, json, reason): a provider's JSON for each of ``rows`` (group, position, scope, prompt, error), or why there is none.

    The provider is called in tasks, with a prompt and the complaints so far, up
    to RETRIES times again. Groups run side by side, the rows of one in order of
    position. An OSError of the provider, or output that never fits, ends its
    group: later rows are not asked. A row with an error, or without a prompt, is
    not asked either and ends nothing. Other exceptions fail the job. A task that
    is run again asks again.
    """

    def one(prompt: str) -> tuple[str | None, str | None]:
        complaints: list[str] = []
        for _ in range(RETRIES + 1):
            try:
                text = provider(prompt, list(complaints))
            except OSError as e:
                return None, str(e) or type(e).__name__
            if _fits(text, form):
                return text, None
            complaints.append("the output does not fit the schema")
        return None, f"no valid output after {RETRIES + 1} attempts"

    def run(batches):
        group, ended = None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.group != group:
                    group, ended = row.group, False
                if ended:
                    out.append((row.scope, None, "skipped after an earlier error"))
                elif row.error is not None or row.prompt is None:
                    out.append((row.scope, None, row.error or "no prompt"))
                else:
                    text, reason = one(row.prompt)
                    ended = reason is not None
                    out.append((row.scope, text, reason))
            yield pd.DataFrame(out, columns=["scope", "json", "reason"])

    rows = rows.select(F.col("group").cast("string"), "position", F.col("scope").cast("string"), "prompt", "error")
    return rows.repartition("group").sortWithinPartitions("group", "position", "scope").mapInPandas(run, "scope string, json string, reason string")


def move(sections: DataFrame, reused: DataFrame, moved: DataFrame) -> DataFrame:
    """(section_id, walkthrough): the ``sections`` (section_id, walkthrough) that can be kept, with every line where it is now.

    ``reused`` is of ``freshness.reuse_sections``, ``moved`` of
    ``relocate_references``. References whose code is gone go; the note on them
    joins what is unresolved.
    """
    at = lambda file, line: F.concat(file, F.lit(":"), line.cast("string"))
    known = moved.where("now is not null").select("section_id", F.struct(at(F.col("file"), F.col("line")).alias("k"), "now").alias("e"))
    known = known.groupBy("section_id").agg(F.map_from_entries(F.collect_set("e")).alias("_now"))
    joined = sections.join(reused.select("section_id", "delta", "note"), "section_id").join(known, "section_id", "left")

    def step(x):
        code = x["code_ref"]
        code = code.withField("start", (code["start"] + F.col("delta")).cast("int")).withField("end", (code["end"] + F.col("delta")).cast("int"))
        references = F.transform(x["references"], lambda r: r.withField("line", F.try_element_at(F.col("_now"), at(r["file"], r["line"])).cast("int")))
        return x.withField("code_ref", code).withField("references", F.filter(references, lambda r: r["line"].isNotNull()))

    stages = F.transform("walkthrough.stages", lambda s: s.withField("steps", F.transform(s["steps"], step)))
    notes = F.concat(F.coalesce("walkthrough.unresolved", F.array().cast("array<string>")), F.when(F.col("note").isNotNull(), F.array("note")).otherwise(F.array().cast("array<string>")))
    return joined.select("section_id", F.col("walkthrough").withField("stages", stages).withField("unresolved", notes).alias("walkthrough"))


def regenerate(order: DataFrame, kept: DataFrame, written: DataFrame, provider: Provider, files: DataFrame, words: DataFrame, packages: DataFrame, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """Explain files function by function: (sections, failed).

    * sections (file, position, symbol, scope, walkthrough, origin): origin is
      "generated" or "reused";
    * failed (file, position, symbol, scope, reason).

    ``order`` has file, position, symbol and scope, a scope for each function;
    ``kept`` (scope, walkthrough) is what can still be used, from ``move``;
    ``written`` (scope, prompt, error) the prompts; the others are as for
    ``grounding.verify``. Only functions without a kept section are asked for, with
    ``refresh`` all; where that fails, a kept section stays. Empty tables give
    empty results.
    """
    have = order.join(kept.select("scope", F.col("walkthrough").alias("_kept")), "scope", "left")
    wanted = have if refresh else have.where("_kept is null")
    rows = wanted.select(F.col("file").alias("group"), "position", "scope").join(written.select("scope", "prompt", "error"), "scope", "left")
    asked = graph.settle(ask(rows, provider, WALKTHROUGH_FORM))
    parsed = grounding.parse_walkthroughs(asked.where("json is not null")).where("walkthrough is not null")
    done, _, _ = grounding.verify(parsed, files, words, packages)
    good = done.where(F.size("walkthrough.stages") > 0).select("scope", F.col("walkthrough").alias("_new"))
    judged = graph.settle(have.join(good, "scope", "left").join(asked.select("scope", "reason"), "scope", "left"))
    key = ["file", "position", "symbol", "scope"]
    origin = F.when(F.col("_new").isNotNull(), "generated").otherwise("reused").alias("origin")
    sections = judged.where("_new is not null or _kept is not null").select(*key, F.coalesce("_new", "_kept").alias("walkthrough"), origin)
    failed = judged.where("_new is null and _kept is null").select(*key, F.coalesce("reason", F.lit("no step could be verified")).alias("reason"))
    return sections, failed


def answer(questions: DataFrame, steps: DataFrame, judged: DataFrame, written: DataFrame, lines: DataFrame, provider: Provider, files: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answer questions (question_id, kind, scope, step_id, question) about steps: (answered, refused).

    * answered (question_id, scope, step_id, question, answer, references, warnings, step_hash);
    * refused (question_id, reason): without text or too long, without such a
      step, about code that has changed since, or without a valid answer.

    ``steps`` has scope, step_id, facts (the scope of the facts: of one function in
    a file's walkthrough), explanation and hash; ``judged`` scope, step_id, fresh
    and where the step is now; ``written`` (scope, prompt) the prompts that the
    walkthroughs were made from; ``lines`` file and lines; ``files`` and ``words``
    are keyed by the scope of the facts. A null question counts as empty.
    """
    text = F.regexp_replace(F.coalesce("question", F.lit("")), r"^\s+|\s+$", "")
    at = judged.select("scope", "step_id", "fresh", "file", "start", "end")
    known = steps.select("scope", "step_id", "facts", "explanation", "hash", F.lit(True).alias("_known"))
    joined = questions.select("question_id", "kind", "scope", "step_id", text.alias("question")).join(known, ["scope", "step_id"], "left").join(at, ["scope", "step_id"], "left")
    reason = (
        F.when(F.col("question") == "", F.lit("Ask a question first."))
        .when(F.length("question") > MOST_QUESTION, F.lit(f"Questions are limited to {MOST_QUESTION} characters."))
        .when(F.col("_known").isNull(), F.concat(F.lit('No step "'), F.col("step_id"), F.lit('" in the '), F.col("kind"), F.lit(" walkthrough "), F.col("scope"), F.lit(".")))
        .when(~F.coalesce("fresh", F.lit(False)), F.concat(F.lit("Step "), F.col("step_id"), F.lit("'s code changed since it was explained; regenerate the walkthrough before asking about it.")))
    )
    joined = graph.settle(joined.withColumn("reason", reason))
    open_ = joined.where("reason is null").join(written.select(F.col("scope").alias("facts"), "prompt"), "facts", "left").join(lines.select("file", "lines"), "file", "left")
    code = block_lines(F.coalesce("lines", F.array().cast("array<string>")), F.col("start"), F.col("end"))
    full = prompts.question_prompt(prompts.facts_of(F.col("prompt")), F.col("step_id"), F.col("file"), F.col("start"), code, F.col("explanation"), F.col("question"))
    rows = open_.select(F.col("question_id").alias("group"), F.lit(0).alias("position"), F.col("question_id").alias("scope"), F.when(F.col("prompt").isNotNull(), full).alias("prompt"), F.lit(None).cast("string").alias("error"))
    asked = graph.settle(ask(rows, provider, ANSWER_FORM))
    asked = asked.withColumnRenamed("scope", "_id").withColumn("a", F.from_json("json", ANSWER))
    got = joined.where("reason is null").drop("reason").join(asked, F.col("question_id").cast("string") == F.col("_id"))
    valid = got.where("a.answer is not null")
    checked = grounding.check_answers(valid.select(F.col("facts").alias("scope"), "question_id", "a.answer", "a.references"), files, words)
    answered = valid.select("question_id", "scope", "step_id", "question", "a.answer", F.col("hash").alias("step_hash")).join(checked.drop("scope"), "question_id")
    wrong = got.where("a.answer is null").select("question_id", F.coalesce("reason", F.lit("no valid answer")).alias("reason"))
    return answered, joined.where("reason is not null").select("question_id", "reason").unionByName(wrong)
