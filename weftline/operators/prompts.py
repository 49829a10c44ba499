"""What a provider is shown: the facts of a context as text, one prompt for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contexts import Index, symbols_with_ids

#: What every prompt for a walkthrough ends with; a question takes its place.
INSTRUCTION = "\n\nWrite "
#: (title, whether to say so where there is nothing), in the order of sections.
SECTIONS = [(None, False), ("Declared inside", False), ("Callers", True), ("Callees", True), ("Code", False), ("Packages", True), ("Unresolved calls", False), ("Left out for lack of room", False), ("Files that may be cited", False)]


def fenced(file: Column, start: Column, code: Column) -> Column:
    """Lines of code with their numbers, in a fence that names the place."""
    last = start + F.size(code) - 1
    body = F.transform(code, lambda line, i: F.concat(F.lpad((start + i).cast("string"), F.length(last.cast("string")), F.lit(" ")), F.lit(" | "), line))
    return F.concat(F.lit('```ts title="'), place(file, start, last), F.lit('"\n'), F.array_join(body, "\n"), F.lit("\n```"))


def place(file: Column, start: Column, end: Column = None) -> Column:
    at = F.concat(file, F.lit(":"), start.cast("string"))
    return at if end is None else F.concat(at, F.lit("-"), end.cast("string"))


def _item(*parts: Column | str) -> Column:
    """A list item of columns and plain texts; a null part counts as empty."""
    return F.concat(F.lit("- "), *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def fn_prompts(index: Index, context: dict[str, DataFrame], condensed: bool = False) -> DataFrame:
    """(target, prompt, error): the facts of each function context as text; no prompt but the error for a target without one.

    A target's text is bounded by the token budget of its context. Empty tables
    give prompts that say so. Equal facts are listed once.
    """
    s = symbols_with_ids(index)
    named = lambda prefix: s.select(*(F.col(c).alias(f"{prefix}_{c}") for c in s.columns))
    shown = lambda p="": F.concat(F.col(f"{p}kind"), F.lit(" `"), F.col(f"{p}name"), F.lit("` ("), place(F.col(f"{p}file"), F.col(f"{p}start_line"), F.col(f"{p}end_line")), F.lit(")"), F.coalesce(F.concat(F.lit(": `"), F.col(f"{p}signature"), F.lit("`")), F.lit("")))
    part = lambda rows, n, order, text: rows.select("target", F.lit(n).alias("section"), F.struct(*order).cast("string").alias("place"), text.alias("text"))
    number = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")

    good = context["spans"].where("error is null")
    span = place(F.col("file"), F.col("start"), F.col("end"))
    head = good.join(s.select("symbol_id", "kind", "name"), "symbol_id", "left")
    title = F.concat(F.lit("# Target: "), F.coalesce(F.concat_ws(" ", "kind", "name"), F.lit("")), F.lit(" at "), span)
    callers = context["callers"].join(named("caller"), F.col("caller_id") == F.col("caller_symbol_id"))
    callees = context["callees"].join(named("caller"), F.col("caller_id") == F.col("caller_symbol_id")).join(named("callee"), F.col("callee_id") == F.col("callee_symbol_id"), "left")
    by_text = F.concat(F.lit("`"), F.col("callee_text"), F.when(F.col("resolved"), F.lit("` (package or built-in)")).otherwise(F.lit("` (unresolved)")))
    called = F.when(F.col("callee_symbol_id").isNotNull(), shown("callee_")).otherwise(by_text)
    fits, missed = context["code"].where("fits and size(code) > 0"), context["code"].where("not fits")
    where = place(F.col("file"), F.col("start"), F.col("shown_end"))
    rows = [
        part(head, 0, [F.lit("")], title),
        part(context["inner"], 1, [number("start_line"), F.col("name")], _item(shown())),
        part(callers, 2, [F.col("caller_file"), number("call_line")], _item(shown("caller_"), " calls it at ", place(F.col("caller_file"), F.col("call_line")))),
        part(callees, 3, [number("depth"), F.col("caller_file"), number("call_line"), F.col("callee_text")], _item("depth ", F.col("depth"), ": ", F.col("caller_name"), " at ", place(F.col("caller_file"), F.col("call_line")), " calls ", called)),
        part(fits, 4, [F.col("rank")], F.concat(F.col("part"), F.lit(" "), where, F.lit("\n\n"), fenced(F.col("file"), F.col("start"), F.col("code")))),
        part(context["packages"], 5, [F.col("package")], _item(F.col("package"), F.coalesce(F.concat(F.lit("@"), F.col("version")), F.lit("")), ": ", F.array_join("imported_names", ", "))),
        part(context["unresolved"], 6, [F.col("file"), number("line")], _item(F.col("note"))),
        part(missed, 7, [F.col("rank")], _item(F.col("part"), " ", place(F.col("file"), F.col("start"), F.col("end")))),
        part(context["files"], 8, [F.col("file")], _item(F.col("file"), ": ", F.col("line_count"), " lines")),
    ]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    told = every.groupBy("target").agg(F.array_sort(F.collect_set(F.struct("section", "place", "text"))).alias("told"))
    texts = lambda n: F.transform(F.filter("told", lambda t: t["section"] == n), lambda t: t["text"])
    parts = [F.array_join(texts(0), "\n\n")]
    for n, (name, always) in enumerate(SECTIONS[1:], 1):
        own = F.concat(F.lit(f"## {name}\n\n"), F.array_join(texts(n), "\n\n" if name == "Code" else "\n"))
        parts.append(F.when(F.size(texts(n)) > 0, own).otherwise(F.lit(f"## {name}\n\n(none)") if always else None))
    end = F.concat(F.lit(INSTRUCTION.lstrip() + "the walkthrough of "), span, F.lit("." + (" Keep it short: at most five steps, each of several lines." if condensed else "")))
    prompt = F.concat_ws("\n\n", *parts, end)
    written = good.join(told, "target").select("target", prompt.alias("prompt"), F.lit(None).cast("string").alias("error"))
    return written.unionByName(context["spans"].where("error is not null").select("target", F.lit(None).cast("string").alias("prompt"), "error"))


def facts_of(prompt: Column) -> Column:
    """A prompt without the instruction that it ends with."""
    after = F.substring_index(prompt, INSTRUCTION, -1)
    before = F.substring(prompt, F.lit(1), F.length(prompt) - F.length(after) - len(INSTRUCTION))
    return F.when(F.instr(prompt, INSTRUCTION) > 1, before).otherwise(prompt)


def question_prompt(facts: Column, step_id: Column, file: Column, start: Column, code: Column, explanation: Column, question: Column) -> Column:
    """A question about one step, with the facts its walkthrough was written from and the step's lines as they are now."""
    at = F.concat(F.lit("Step "), step_id, F.lit(" at "), place(file, start, start + F.size(code) - 1))
    return F.concat_ws("\n\n", F.lit("# Facts"), facts, F.lit("# Step"), at, fenced(file, start, code), F.concat(F.lit("Explained as: "), explanation), F.lit("# Question"), question, F.lit("Answer it from these facts alone."))
