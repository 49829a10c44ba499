"""Verification: every cited line must exist and every named identifier be known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGE_WORDS, backticked, identifiers, span_identifiers

STEP = (
    "struct<id:string,code_ref:struct<file:string,start:int,end:int>,explanation:string,example:struct<input:string,state_after:string>,"
    "references:array<struct<file:string,line:int,role:string>>,docs:array<struct<package:string,symbol:string>>,concepts:array<string>,risks:array<string>>"
)
WALKTHROUGH = f"struct<title:string,summary:string,stages:array<struct<name:string,steps:array<{STEP}>>>,unresolved:array<string>>"


def vocabulary(texts: DataFrame) -> DataFrame:
    """(scope, word): the distinct identifiers of a scope's texts (scope, text), and the language's own words in every scope."""
    named = texts.select("scope", F.explode(identifiers(F.coalesce("text", F.lit("")))).alias("word"))
    own = texts.select("scope").distinct().withColumn("word", F.explode(F.array(*map(F.lit, LANGUAGE_WORDS))))
    return named.unionByName(own).distinct()


def steps_of(walkthroughs: DataFrame) -> DataFrame:
    """(scope, stage_at, step_at, stage, step): the steps of nested walkthroughs (scope, walkthrough)."""
    stages = walkthroughs.select("scope", F.posexplode("walkthrough.stages").alias("stage_at", "s"))
    return stages.select("scope", "stage_at", F.col("s.name").alias("stage"), F.posexplode("s.steps").alias("step_at", "step"))


def parse_walkthroughs(texts: DataFrame) -> DataFrame:
    """(scope, walkthrough) from JSON (scope, json); text that does not parse gives null."""
    return texts.select("scope", F.from_json("json", WALKTHROUGH.replace("`", "")).alias("walkthrough"))


def _where(file: Column, line: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"))


def check_steps(steps: DataFrame, files: DataFrame, words: DataFrame) -> DataFrame:
    """``steps`` (scope, step, ...) with reasons, an array of why a step must go; empty for one that stays.

    ``files`` (scope, file, line_count) is what may be cited, ``words`` (scope,
    word) what may be named. Counts and unknown names are joined in: citations by
    file, names by word, so that no vocabulary is carried along with a step.
    """
    keyed = steps.withColumn("_key", F.struct("stage_at", "step_at"))
    cited = keyed.select("scope", "_key", F.posexplode(F.concat(F.array(F.struct(F.lit(-1).alias("nth"), "step.code_ref.file", "step.code_ref.start", "step.code_ref.end")), F.transform("step.references", lambda r, i: F.struct(i.alias("nth"), r["file"].alias("file"), r["line"].alias("start"), r["line"].alias("end"))))).alias("_i", "c"))
    cited = cited.select("scope", "_key", "c.*").join(files.select("scope", "file", "line_count"), ["scope", "file"], "left")
    code, lines = F.col("nth") < 0, F.col("line_count").cast("string")
    span = F.concat(_where(F.col("file"), F.col("start")), F.lit("-"), F.col("end").cast("string"))
    reason = (
        F.when(code & F.col("line_count").isNull(), F.concat(F.lit("code_ref cites "), F.col("file"), F.lit(", which is not part of the indexed context")))
        .when(code & ((F.col("start") < 1) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("line_count"))), F.concat(F.lit("code_ref "), span, F.lit(" is outside the file's lines 1-"), lines))
        .when(~code & F.col("line_count").isNull(), F.concat(F.lit("reference "), _where(F.col("file"), F.col("start")), F.lit(" cites a file that is not part of the indexed context")))
        .when(~code & ((F.col("start") < 1) | (F.col("start") > F.col("line_count"))), F.concat(F.lit("reference "), _where(F.col("file"), F.col("start")), F.lit(" is outside the file's lines 1-"), lines))
    )
    bad = cited.select("scope", "_key", F.struct("nth", reason.alias("reason")).alias("r")).where("r.reason is not null")
    bad = bad.groupBy("scope", "_key").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["reason"]).alias("_bad"))
    unknown = unknown_names(keyed.select("scope", "_key", F.col("step.explanation").alias("text")), words)
    named = F.concat(F.lit("explanation names identifiers not found in the code or index: "), backticked(F.col("_unknown")))
    none = F.array().cast("array<string>")
    joined = keyed.join(bad, ["scope", "_key"], "left").join(unknown.withColumnRenamed("unknown", "_unknown"), ["scope", "_key"], "left")
    reasons = F.concat(F.coalesce("_bad", none), F.when(F.col("_unknown").isNotNull(), F.array(named)).otherwise(none))
    return joined.withColumn("reasons", reasons).drop("_key", "_bad", "_unknown")


def unknown_names(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(scope, _key, unknown): identifiers of code spans (scope, _key, text) that ``words`` lacks, in order of mention."""
    named = texts.select("scope", "_key", F.posexplode(span_identifiers(F.coalesce("text", F.lit("")))).alias("at", "word"))
    lost = named.join(words, ["scope", "word"], "left_anti")
    return lost.groupBy("scope", "_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("unknown"))


def verify(walkthroughs: DataFrame, files: DataFrame, words: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verified walkthroughs, dropped steps and removed docs.

    * (scope, walkthrough): without steps that fail, stages left empty, and docs of packages not in ``packages`` (scope, package);
    * (scope, step_id, reasons);
    * (scope, step_id, package, symbol).
    """
    checked = check_steps(steps_of(walkthroughs), files, words)
    dropped = checked.where(F.size("reasons") > 0).select("scope", F.col("step.id").alias("step_id"), "reasons")
    kept = checked.where(F.size("reasons") == 0)
    docs = kept.select("scope", "stage_at", "step_at", F.col("step.id").alias("step_id"), F.posexplode("step.docs").alias("doc_at", "d")).select("scope", "stage_at", "step_at", "step_id", "doc_at", "d.package", "d.symbol")
    removed = docs.join(packages, ["scope", "package"], "left_anti")
    left = docs.join(packages, ["scope", "package"], "left_semi").groupBy("scope", "stage_at", "step_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_at", "package", "symbol"))), lambda d: F.struct(d["package"].alias("package"), d["symbol"].alias("symbol"))).alias("_docs"))
    kept = kept.join(left, ["scope", "stage_at", "step_at"], "left")
    kept = kept.withColumn("step", F.col("step").withField("docs", F.coalesce("_docs", F.array().cast("array<struct<package:string,symbol:string>>"))))
    stages = kept.groupBy("scope", "stage_at").agg(F.first("stage").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("step_at", "step"))), lambda s: s["step"]).alias("steps"))
    stages = stages.groupBy("scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("stage_at", "name", "steps"))), lambda s: F.struct(s["name"].alias("name"), s["steps"].alias("steps"))).alias("_stages"))
    empty = F.array().cast(f"array<struct<name:string,steps:array<{STEP}>>>")
    done = walkthroughs.join(stages, "scope", "left").withColumn("walkthrough", F.col("walkthrough").withField("stages", F.coalesce("_stages", empty))).drop("_stages")
    return done, dropped, removed.select("scope", "step_id", "package", "symbol")


def check_answers(answers: DataFrame, files: DataFrame, words: DataFrame) -> DataFrame:
    """(scope, question_id, references, warnings): answers (scope, question_id, answer, references) keep what they can cite; the rest is warned about."""
    refs = answers.select("scope", "question_id", F.posexplode("references").alias("at", "r")).select("scope", "question_id", "at", "r.file", "r.line", "r.role").join(files, ["scope", "file"], "left")
    at = F.concat(F.lit("Removed reference "), _where(F.col("file"), F.col("line")))
    warning = F.when(F.col("line_count").isNull(), F.concat(at, F.lit(": not part of the indexed context."))).when((F.col("line") < 1) | (F.col("line") > F.col("line_count")), F.concat(at, F.lit(": outside the file's lines 1-"), F.col("line_count").cast("string"), F.lit(".")))
    rows = refs.withColumn("w", warning).groupBy("scope", "question_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("w").isNull(), F.struct("at", "file", "line", "role")))).alias("_kept"), F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("at", "w")))).alias("_lost")
    )
    unknown = unknown_names(answers.select("scope", F.struct("question_id").alias("_key"), F.col("answer").alias("text")), words).select("scope", F.col("_key.question_id").alias("question_id"), "unknown")
    joined = answers.select("scope", "question_id").join(rows, ["scope", "question_id"], "left").join(unknown, ["scope", "question_id"], "left")
    none = F.array().cast("array<string>")
    names = F.when(F.col("unknown").isNotNull(), F.array(F.concat(F.lit("Names identifiers not found in the code or index: "), backticked(F.col("unknown"))))).otherwise(none)
    kept = F.transform(F.coalesce("_kept", F.array().cast("array<struct<at:int,file:string,line:int,role:string>>")), lambda r: F.struct(r["file"].alias("file"), r["line"].alias("line"), r["role"].alias("role")))
    lost = F.transform(F.coalesce("_lost", F.array().cast("array<struct<at:int,w:string>>")), lambda r: r["w"])
    return joined.select("scope", "question_id", kept.alias("references"), F.concat(lost, names).alias("warnings"))


def line_stub(scopes: DataFrame) -> DataFrame:
    """(scope, walkthrough) with one step for each line of a target (scope, file, start, end): a generator for tests that needs no model."""
    step = lambda n: F.from_json(F.to_json(F.struct(F.concat(F.lit("s"), (n - F.col("start") + 1).cast("string")).alias("id"), F.struct(F.col("file"), n.alias("start"), n.alias("end")).alias("code_ref"), F.concat(F.lit("Line "), n.cast("string")).alias("explanation"), F.array().cast("array<struct<file:string,line:int,role:string>>").alias("references"), F.array().cast("array<struct<package:string,symbol:string>>").alias("docs"))), STEP)
    steps = F.transform(F.sequence("start", "end"), step)
    none = F.array().cast("array<string>")
    return scopes.select("scope", F.struct(F.lit("Lines").alias("title"), F.lit("").alias("summary"), F.array(F.struct(F.lit("All").alias("name"), steps.alias("steps"))).alias("stages"), none.alias("unresolved")).alias("walkthrough"))
