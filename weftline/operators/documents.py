"""Saved walkthroughs and questions: versioned documents, their digests, upserts, mirrors and documentation links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import document_slug, repository_url
from ..functions.text import digest
from . import relational

VERSION = 2


def load(saved: DataFrame) -> DataFrame:
    """Documents of the current version; others count as absent."""
    return saved.where(F.col("version") == VERSION)


def save(saved: DataFrame, new: DataFrame) -> DataFrame:
    """``saved`` (kind, ref, content, created_at) with ``new`` written over it; unchanged content keeps its time."""
    return relational.upsert(saved, new, ["kind", "ref"], "content", "created_at")


def newest(saved: DataFrame) -> DataFrame:
    """Of several documents of one scope (kind, ref, id, ...) the newest."""
    return relational.keep_first(saved, ["kind", "ref"], [F.desc("id")])


def ask(questions: DataFrame, new: DataFrame) -> DataFrame:
    """``questions`` with ``new`` ones appended under ids that go on from the largest."""
    last = questions.agg(F.max("id")).first()[0] or 0
    numbered = relational.number_all(new, ["created_at", "kind", "ref", "step_id", "question"], last)
    return questions.unionByName(numbered.select(questions.columns))


def questions_of(questions: DataFrame, scopes: DataFrame) -> DataFrame:
    """The questions of scopes (kind, ref), oldest first in each: with position from 0."""
    return relational.number_rows(questions.join(scopes.select("kind", "ref").distinct(), ["kind", "ref"], "left_semi"), ["kind", "ref"], ["created_at", "id"])


def drop_older(saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the newest document of each scope, and the (id) of the others."""
    kept = newest(saved)
    return kept, saved.select("id").join(kept.select("id"), "id", "left_anti")


def content_hashes(blocks: DataFrame) -> DataFrame:
    """(scope, content_hash) over a scope's blocks (scope, position, file, symbol, start, end, hash) in order."""
    place = F.coalesce("symbol", F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    key = F.concat("file", F.lit("#"), place, F.lit(":"), "hash")
    rows = blocks.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("position", key.alias("key")))).alias("rows"))
    return rows.select("scope", digest(F.transform("rows", lambda r: r["key"])).alias("content_hash"))


def explained_steps(sections: DataFrame) -> DataFrame:
    """(scope, step_id, hash, generated_at) from sections' step_hashes maps; in file scopes a step is named after its function too."""
    rows = sections.select("scope", "kind", "symbol", "generated_at", F.explode("step_hashes").alias("id", "hash"))
    named = F.when(F.col("kind") == "file", F.concat_ws("/", F.coalesce("symbol", F.lit("block")), "id")).otherwise(F.col("id"))
    return rows.select("scope", named.alias("step_id"), "hash", "generated_at")


def flatten(sections: DataFrame) -> DataFrame:
    """(scope, stages, unresolved): the sections (scope, position, symbol, walkthrough) of a file as one walkthrough."""
    owner = F.coalesce("symbol", F.lit("block"))
    stages = F.transform(
        "walkthrough.stages",
        lambda s: s.withField("name", F.concat_ws(" · ", owner, s["name"])).withField("steps", F.transform(s["steps"], lambda x: x.withField("id", F.concat_ws("/", owner, x["id"])))),
    )
    rows = sections.select("scope", F.struct("position", stages.alias("stages"), F.col("walkthrough.unresolved").alias("unresolved")).alias("r"))
    grouped = rows.groupBy("scope").agg(F.collect_list("r").alias("rows"))
    ordered = F.array_sort("rows", lambda a, b: a["position"] - b["position"])
    return grouped.select("scope", F.flatten(F.transform(ordered, lambda r: r["stages"])).alias("stages"), F.array_distinct(F.flatten(F.transform(ordered, lambda r: r["unresolved"]))).alias("unresolved"))


def mirror(saved: DataFrame, folder: str) -> None:
    """Write documents (kind, ref, content) as JSON lines under readable names, one partition each."""
    named = saved.select(document_slug(F.col("kind"), F.col("ref")).alias("name"), "kind", "ref", "content")
    named.write.mode("overwrite").partitionBy("name").json(folder)


# Documentation addresses of common packages.
PAGES = {
    "express": "https://expressjs.com/en/{}/api.html", "react": "https://react.dev/reference/react", "pg": "https://node-postgres.com", "ioredis": "https://github.com/redis/ioredis#readme",
    "zod": "https://zod.dev/api", "zod3": "https://v3.zod.dev/", "node": "https://nodejs.org/api/{}.html", "redis": "https://redis.io/docs/latest/commands/{}/", "npm": "https://www.npmjs.com/package/{}",
}
REACT_NAMES = r"^(use[A-Z]\w*|memo|forwardRef|createContext|lazy|startTransition|Suspense|Fragment|StrictMode)$"


def documentation_url(package: Column, symbol: Column, version: Column, imported_path: Column, homepage: Column, repository: Column) -> Column:
    """struct(url, source): a known page for the package, else its manifest's homepage or repository, else its registry page."""
    major = F.regexp_extract(version, r"(\d+)", 1).try_cast("int")
    last = F.element_at(F.split(F.regexp_replace(symbol, r"\(.*$", ""), r"\."), -1)
    page = lambda name, *more: F.format_string(PAGES[name].replace("{}", "%s"), *more)
    express = page("express", F.when(major >= 5, "5x").otherwise("4x"))
    anchor = F.when(symbol == "Router", "express.router").when(symbol.rlike(r"(?i)^(express|app|router|req|res)\.\w+$"), F.lower(symbol))
    known = (
        F.when(package == "express", F.concat(express, F.when(anchor.isNotNull(), F.concat(F.lit("#"), anchor)).otherwise("")))
        .when(package == "react", F.when(last.rlike(REACT_NAMES), F.concat(F.lit(PAGES["react"] + "/"), last)).otherwise(PAGES["react"]))
        .when(package == "pg", F.concat(F.lit(PAGES["pg"]), F.when(symbol.rlike("(?i)pool"), "/apis/pool").when(symbol.rlike("(?i)client"), "/apis/client").when(symbol.rlike("(?i)result|rows"), "/apis/result").otherwise("")))
        .when(package == "ioredis", F.when(last.rlike("^[a-z]+$"), page("redis", last)).otherwise(PAGES["ioredis"]))
        .when(package == "zod", F.when(major < 4, PAGES["zod3"]).otherwise(PAGES["zod"]))
        .when(package == "node", page("node", F.element_at(F.split(F.regexp_replace(imported_path, "^node:", ""), "/"), 1)))
    )
    own = F.coalesce(F.when(homepage.rlike("^https?://"), homepage), repository_url(repository))
    registry = F.concat(page("npm", package), F.when(version.rlike(r"^\d+\.\d+\.\d+"), F.concat(F.lit("/v/"), version)).otherwise(""))
    source = F.when(known.isNotNull(), "curated").when(own.isNotNull(), "package.json").otherwise("npm")
    return F.struct(F.coalesce(known, own, registry).alias("url"), source.alias("source"))
