"""Operators of the index over facts derived from ordinary tables: parts as symbols, line items as calls, documents as files.

Sizes grow with the tables; each query states the same rows in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import contexts, documents, freshness, grounding, walkthroughs
from ..operators.graph import shared_folder
from ..sources import facts, snapshot
from ..sources.tables import table
from .registry import query
from .table_queries import LINES_SQL

KINDS = ["function", "type", "class", "component", "hook"]

INDEX_SQL = f"""sym AS (SELECT 'p' || p_partkey AS symbol_id, 'd' || (p_partkey % 50) AS file, 'f' || (p_partkey % 97) AS name, [{", ".join(f"'{k}'" for k in KINDS)}][CAST(p_size % 5 + 1 AS INTEGER)] AS kind,
  CAST(p_partkey % 400 + 1 AS INTEGER) AS start_line, CAST(p_partkey % 400 + 1 + p_size AS INTEGER) AS end_line, p_size % 2 = 0 AS exported FROM part),
calls AS (SELECT 'p' || l_partkey AS caller_id, CASE WHEN l_linenumber <> 3 THEN 'p' || ((l_partkey * 7 + l_suppkey) % 150 + 1) END AS callee_id, 'c' || l_suppkey AS callee_text,
  CAST(l_partkey % 400 + l_linenumber AS INTEGER) AS call_line, l_suppkey % 4 <> 0 AS resolved, 'd' || (l_partkey % 50) AS file FROM lineitem),
imports AS (SELECT 'd' || (o_custkey % 200) AS file, 'd' || (o_orderkey % 500) AS resolved_path, CASE WHEN o_orderkey % 3 = 0 THEN 'pkg' || (o_orderkey % 17) END AS package_name,
  '1.' || (o_orderkey % 5) AS package_version, 'x' || o_orderkey AS imported_path, o_orderkey AS position FROM orders),
router AS (SELECT 'd' || (s_suppkey % 40) AS file, 'd' || (s_suppkey * 3 % 60) AS key_file, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || (s_suppkey * 5 % 70) END AS factory_file FROM supplier),
files AS (SELECT 'd' || doc_id AS path, doc_id, {LINES_SQL} AS lines, sha256(coalesce(text, '')) AS hash FROM documents),
spans AS (SELECT s_suppkey AS target, 'd' || (s_suppkey % 50) AS file, CAST(s_suppkey % 300 AS INTEGER) AS a, CAST(s_suppkey % 300 + 60 AS INTEGER) AS b, CASE WHEN s_suppkey % 3 > 0 THEN 'p' || s_suppkey END AS own FROM supplier)"""


def _d(number) -> F.Column:
    return F.concat(F.lit("d"), number.cast("string"))


def _numbered(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def index(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Index tables under the names that the operators ask for."""
    key, size = F.col("p_partkey"), F.col("p_size")
    start = (key % 400 + 1).cast("int")
    symbols = table(spark, base, "part").select(
        _numbered("p", key).alias("symbol_id"), _d(key % 50).alias("file"), _numbered("f", key % 97).alias("name"), F.get(F.array(*map(F.lit, KINDS)), (size % 5).cast("int")).alias("kind"),
        start.alias("start_line"), (start + size).cast("int").alias("end_line"), (size % 2 == 0).alias("exported"), F.lit("").alias("signature"),
    )
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    calls = table(spark, base, "lineitem").select(
        _numbered("p", part).alias("caller_id"), F.when(line != 3, _numbered("p", (part * 7 + supplier) % 150 + 1)).alias("callee_id"), _numbered("c", supplier).alias("callee_text"),
        (part % 400 + line).cast("int").alias("call_line"), (supplier % 4 != 0).alias("resolved"), _d(part % 50).alias("file"),
    )
    order = F.col("o_orderkey")
    imports = table(spark, base, "orders").select(
        _d(F.col("o_custkey") % 200).alias("file"), _d(order % 500).alias("resolved_path"), F.when(order % 3 == 0, _numbered("pkg", order % 17)).alias("package_name"), _numbered("1.", order % 5).alias("package_version"),
        _numbered("x", order).alias("imported_path"), F.array(F.lit("a")).alias("imported_names"), order.alias("position"),
    )
    s = F.col("s_suppkey")
    place = lambda file: F.struct(file.alias("file"))
    handler = F.struct(place(_d(s * 3 % 60)).alias("key"), place(F.when(s % 2 == 0, _d(s * 5 % 70))).alias("factory"))
    router = table(spark, base, "supplier").select(_d(s % 40).alias("file"), F.array(handler).alias("handlers"))
    docs = table(spark, base, "documents")
    files = docs.select(_d(F.col("doc_id")).alias("path"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("hash"))
    return {"symbols": symbols, "calls": calls, "imports": imports, "router_calls": router, "files": files}


def _lines(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").select(_d(F.col("doc_id")).alias("file"), text.split_lines(F.coalesce("text", F.lit(""))).alias("lines"))


def _spans(spark: SparkSession, base: str) -> DataFrame:
    s = F.col("s_suppkey")
    start = (s % 300).cast("int")
    return table(spark, base, "supplier").select(s.alias("target"), _d(s % 50).alias("file"), start.alias("start"), (start + 60).cast("int").alias("end"), F.when(s % 3 > 0, _numbered("p", s)).alias("symbol_id"))


def _touched(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("doc_id % 10 = 3").select(_d(F.col("doc_id")).alias("path"))


TOUCHED_SQL = "t AS (SELECT path FROM files WHERE doc_id % 10 = 3)"


@query("caller_files", f"WITH {INDEX_SQL}, {TOUCHED_SQL} SELECT DISTINCT file AS path FROM calls WHERE callee_id IN (SELECT symbol_id FROM sym WHERE file IN (SELECT path FROM t)) AND file NOT IN (SELECT path FROM t)")
def caller_files(spark, base):
    """Files with a call into touched files, these left out."""
    return snapshot.caller_files(index(spark, base), _touched(spark, base))


@query("importing_files", f"WITH {INDEX_SQL}, {TOUCHED_SQL} SELECT DISTINCT file AS path FROM imports WHERE resolved_path IN (SELECT path FROM t)")
def importing_files(spark, base):
    return snapshot.importers(index(spark, base), _touched(spark, base))


@query("registering_files", f"WITH {INDEX_SQL}, {TOUCHED_SQL} SELECT DISTINCT file AS path FROM router WHERE (key_file IN (SELECT path FROM t) OR factory_file IN (SELECT path FROM t)) AND file NOT IN (SELECT path FROM t)")
def registering_files(spark, base):
    """Elements of nested handler lists that name a touched file."""
    return snapshot.registering_files(index(spark, base), _touched(spark, base))


@query(
    "pass_plan",
    f"""WITH {INDEX_SQL}, now AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'new' ELSE hash END AS hash FROM files WHERE doc_id % 11 <> 0),
c AS (SELECT now.path FROM now JOIN files USING (path) WHERE now.hash <> files.hash), r AS (SELECT path FROM files WHERE path NOT IN (SELECT path FROM now)), t AS (SELECT path FROM c UNION ALL SELECT path FROM r),
h AS (SELECT file AS path FROM imports WHERE resolved_path IN (SELECT path FROM t) UNION SELECT file FROM calls WHERE callee_id IN (SELECT symbol_id FROM sym WHERE file IN (SELECT path FROM t))
  UNION SELECT file FROM router WHERE key_file IN (SELECT path FROM t) OR factory_file IN (SELECT path FROM t))
SELECT path, 'changed' AS change FROM c UNION ALL SELECT path, 'removed' FROM r UNION ALL SELECT path, 'refreshed' FROM h WHERE path IN (SELECT path FROM now) AND path NOT IN (SELECT path FROM t)""",
)
def pass_plan(spark, base):
    """What an index pass has to do where a file in eleven is gone and one in thirteen altered."""
    old = index(spark, base)
    number = F.substring("path", 2, 20).cast("long")
    present = old["files"].where(number % 11 != 0).withColumn("hash", F.when(number % 13 == 0, "new").otherwise(F.col("hash")))
    named = zip(snapshot.plan_pass(snapshot.Snapshot(old), present), ("changed", "removed", "refreshed"), strict=True)
    changed, removed, refreshed = (paths.select("path", F.lit(name).alias("change")) for paths, name in named)
    return changed.unionByName(removed).unionByName(refreshed)


@query(
    "package_imports",
    f"""WITH {INDEX_SQL}, f AS (SELECT c_nationkey AS target, 'd' || (c_custkey % 200) AS file, c_custkey AS position FROM customer)
SELECT target, package_name AS package, arg_min(package_version, (f.position, i.position)) AS version, arg_min(imported_path, (f.position, i.position)) AS imported_path
FROM f JOIN imports i ON i.file = f.file WHERE package_name IS NOT NULL GROUP BY target, package_name""",
)
def package_imports(spark, base):
    """The first import of each package by a target's files."""
    customers = table(spark, base, "customer").select(F.col("c_nationkey").alias("target"), _d(F.col("c_custkey") % 200).alias("file"), F.col("c_custkey").alias("position"))
    return contexts.packages_of(index(spark, base), customers).select("target", "package", "version", "imported_path")


OWNERS_SQL = """inner_ AS (SELECT target, symbol_id FROM spans JOIN sym USING (file) WHERE start_line >= a AND end_line <= b AND kind NOT IN ('type', 'class')),
own AS (SELECT target, own AS symbol_id FROM spans JOIN sym ON symbol_id = own WHERE kind NOT IN ('type', 'class')),
owners AS (SELECT target, symbol_id, (target, symbol_id) IN (SELECT (target, symbol_id) FROM own) AS own FROM (SELECT * FROM inner_ UNION SELECT * FROM own))"""


@query("range_owners", f"WITH {INDEX_SQL}, {OWNERS_SQL} SELECT target, symbol_id, own FROM owners")
def range_owners(spark, base):
    """Code symbols of line ranges: their own and all inside."""
    return contexts.owners_of(index(spark, base), _spans(spark, base)).select("target", "symbol_id", "own")


@query(
    "range_callees",
    f"""WITH {INDEX_SQL}, {OWNERS_SQL}, o AS (SELECT DISTINCT target, symbol_id FROM owners),
one AS (SELECT DISTINCT target, 1 AS depth, caller_id, callee_id, callee_text, call_line, resolved FROM o JOIN calls ON caller_id = symbol_id JOIN spans USING (target)
  WHERE call_line BETWEEN a AND b AND (callee_id IS NULL OR (target, callee_id) NOT IN (SELECT (target, symbol_id) FROM o))),
f AS (SELECT DISTINCT target, callee_id AS symbol_id FROM one WHERE callee_id IS NOT NULL),
two AS (SELECT DISTINCT target, 2 AS depth, caller_id, callee_id, callee_text, call_line, resolved FROM f JOIN calls ON caller_id = symbol_id
  WHERE (target, symbol_id) NOT IN (SELECT (target, symbol_id) FROM o) AND (callee_id IS NULL OR (target, callee_id) NOT IN (SELECT (target, symbol_id) FROM o)))
SELECT * FROM one UNION ALL SELECT * FROM two""",
)
def range_callees(spark, base):
    """Calls of line ranges, direct ones within the range, to a depth of two."""
    found, spans = index(spark, base), _spans(spark, base)
    return contexts.callees_of_spans(found, spans, 2)


@query(
    "range_callers",
    f"""WITH {INDEX_SQL}, {OWNERS_SQL}, x AS (SELECT target, callee_id, caller_id, call_line FROM owners o JOIN sym s USING (symbol_id) JOIN calls ON callee_id = symbol_id WHERE o.own OR s.exported)
SELECT target, caller_id, callee_id, call_line FROM x JOIN sym c ON c.symbol_id = caller_id JOIN spans USING (target) WHERE NOT (c.file = spans.file AND c.start_line >= a AND c.end_line <= b)""",
)
def range_callers(spark, base):
    """Call sites outside line ranges that lead into them, a row each."""
    found, spans = index(spark, base), _spans(spark, base)
    return contexts.callers_of_spans(found, spans)


@query(
    "resolved_targets",
    f"""WITH {INDEX_SQL}, t AS (SELECT s_suppkey AS target, 'd' || (s_suppkey * 7 % 230) AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || (s_suppkey % 97) END AS symbol, CAST(s_suppkey % 40 + 1 AS INTEGER) AS a, CAST(s_suppkey % 40 + 3 AS INTEGER) AS b FROM supplier),
n AS (SELECT target, count(*) AS n, min(symbol_id) AS id, min(start_line) AS a, min(end_line) AS b FROM t JOIN sym s ON s.file = t.file AND s.name = t.symbol GROUP BY target),
r AS (SELECT target, arg_min(symbol_id, (-start_line, end_line, symbol_id)) AS id FROM t JOIN sym s ON s.file = t.file WHERE symbol IS NULL AND start_line <= a AND end_line >= b GROUP BY target),
j AS (SELECT t.target, t.file, t.symbol, t.a, t.b, n.n, n.id AS nid, n.a AS na, n.b AS nb, r.id AS rid, f.path, len(f.lines) AS size FROM t LEFT JOIN n USING (target) LEFT JOIN r USING (target) LEFT JOIN files f ON f.path = t.file),
e AS (SELECT *, CASE WHEN path IS NULL THEN 'unknown' WHEN symbol IS NOT NULL AND n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' WHEN symbol IS NULL AND b > size THEN 'bounds' ELSE 'ok' END AS state FROM j)
SELECT target, state, CASE WHEN state = 'ok' THEN coalesce(nid, rid) END AS symbol_id, CASE WHEN state = 'ok' THEN coalesce(na, a) END AS first_line, CASE WHEN state = 'ok' THEN coalesce(nb, b) END AS last_line FROM e""",
)
def resolved_targets(spark, base):
    """Targets by name or by line range, or which error they meet."""
    s = F.col("s_suppkey")
    first = (s % 40 + 1).cast("int")
    targets = table(spark, base, "supplier").select(s.alias("target"), _d(s * 7 % 230).alias("file"), F.when(s % 2 == 0, _numbered("f", s % 97)).alias("symbol"), first.alias("start"), (first + 2).cast("int").alias("end"))
    found = contexts.resolve_targets(index(spark, base), targets, _lines(spark, base))
    error = F.col("error")
    state = F.when(error.isNull(), "ok").when(error.contains("not in the index"), "unknown").when(error.contains("ambiguous"), "ambiguous").when(error.contains("out of bounds"), "bounds").when(error.contains("No symbol"), "none")
    good = lambda c: F.when(error.isNull(), F.col(c))
    return found.select("target", state.alias("state"), good("symbol_id").alias("symbol_id"), good("start").alias("first_line"), good("end").alias("last_line"))


@query(
    "unresolved_notes",
    f"""WITH {INDEX_SQL} SELECT caller_id AS target, callee_text, s.file, call_line AS line, 'unresolved: likely ' || callee_text || ' (dynamic call in ' || name || ' at ' || s.file || ':' || call_line || ')' AS note
FROM calls JOIN sym s ON s.symbol_id = caller_id WHERE NOT resolved""",
)
def unresolved_notes(spark, base):
    found = index(spark, base)
    return contexts.unresolved_notes(found, found["calls"].drop("file").withColumn("target", F.col("caller_id")))


@query(
    "code_budget",
    f"""WITH RECURSIVE d AS (SELECT source AS target, doc_id, ceil(length(array_to_string({LINES_SQL}, chr(10))) / 4.0) + 10 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (
  SELECT target, doc_id, n, cost <= 2000 AS fits, CASE WHEN cost <= 2000 THEN 2000 - cost ELSE 2000 END AS remaining FROM d WHERE n = 1
  UNION ALL SELECT d.target, d.doc_id, d.n, d.cost <= f.remaining, CASE WHEN d.cost <= f.remaining THEN f.remaining - d.cost ELSE f.remaining END FROM f JOIN d ON d.target IS NOT DISTINCT FROM f.target AND d.n = f.n + 1
) SELECT doc_id, fits FROM f WHERE target IS NOT NULL""",
)
def code_budget(spark, base):
    """Which code blocks of a context fit, in order of rank."""
    docs = table(spark, base, "documents").where("source is not null")
    blocks = docs.select("doc_id", F.col("source").alias("target"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rank"), text.split_lines(F.coalesce("text", F.lit(""))).alias("code"))
    return contexts.within_budget(blocks, 2000 + contexts.RESERVED_TOKENS).select("doc_id", "fits")


@query(
    "verified_steps",
    f"""WITH {INDEX_SQL}, s AS (SELECT conv_id, turn, 'd' || (conv_id % 250) AS file, turn AS a, turn + 4 AS b, 'd' || (conv_id % 240) AS ref, conv_id % 9 AS ref_line, role FROM conversations),
j AS (SELECT s.*, len(f.lines) AS n, len(g.lines) AS m FROM s LEFT JOIN files f ON f.path = s.file LEFT JOIN files g ON g.path = s.ref)
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN n IS NULL THEN 'code_ref cites ' || file || ', which is not part of the indexed context' WHEN a < 1 OR b < a OR b > n THEN 'code_ref ' || file || ':' || a || '-' || b || ' is outside the file''s lines 1-' || n END,
  CASE WHEN m IS NULL THEN 'reference ' || ref || ':' || ref_line || ' cites a file that is not part of the indexed context' WHEN ref_line < 1 OR ref_line > m THEN 'reference ' || ref || ':' || ref_line || ' is outside the file''s lines 1-' || m END,
  CASE WHEN role <> 'user' THEN 'explanation names identifiers not found in the code or index: `' || role || '`' END], lambda x: x IS NOT NULL), '|') AS reasons FROM j""",
)
def verified_steps(spark, base):
    """Steps of explanations that cite lines and name identifiers, and why they must go."""
    turn, conv = F.col("turn").cast("int"), F.col("conv_id")
    step = F.struct(
        F.struct(_d(conv % 250).alias("file"), turn.alias("start"), (turn + 4).cast("int").alias("end")).alias("code_ref"), F.concat(F.lit("Calls `"), "role", F.lit("` here")).alias("explanation"),
        F.array(F.struct(_d(conv % 240).alias("file"), (conv % 9).cast("int").alias("line"), F.lit("r").alias("role"))).alias("references"),
    )
    steps = table(spark, base, "conversations").select(F.lit("all").alias("scope"), conv.alias("stage_at"), "turn", F.col("turn").alias("step_at"), step.alias("step"))
    files = _lines(spark, base).select(F.lit("all").alias("scope"), "file", F.size("lines").alias("line_count"))
    words = spark.createDataFrame([("all", "user")], "scope string, word string")
    return grounding.check_steps(steps, files, words).select(F.col("stage_at").alias("conv_id"), "turn", F.array_join("reasons", "|").alias("reasons"))


@query(
    "located_blocks",
    f"""WITH {INDEX_SQL}, b AS (SELECT s_suppkey AS block_id, 'd' || (s_suppkey % 50) AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || (s_suppkey % 97) END AS symbol, CAST(s_suppkey % 30 + 1 AS INTEGER) AS a, CAST(s_suppkey % 30 + 2 AS INTEGER) AS b FROM supplier),
n AS (SELECT block_id, arg_min(start_line, (abs(start_line - a), start_line, -end_line)) AS s, arg_min(end_line, (abs(start_line - a), start_line, -end_line)) AS e FROM b JOIN sym ON sym.file = b.file AND sym.name = b.symbol GROUP BY block_id)
SELECT block_id, CASE WHEN path IS NULL THEN NULL WHEN symbol IS NOT NULL THEN s WHEN b <= len(lines) THEN a END AS first_line, CASE WHEN path IS NULL THEN NULL WHEN symbol IS NOT NULL THEN e WHEN b <= len(lines) THEN b END AS last_line
FROM b LEFT JOIN n USING (block_id) LEFT JOIN files ON path = b.file""",
)
def located_blocks(spark, base):
    """Where explained blocks stand now: by the nearest symbol of their name, else by their lines."""
    s = F.col("s_suppkey")
    first = (s % 30 + 1).cast("int")
    blocks = table(spark, base, "supplier").select(s.alias("block_id"), _d(s % 50).alias("file"), F.when(s % 2 == 0, _numbered("f", s % 97)).alias("symbol"), first.alias("start"), (first + 1).cast("int").alias("end"), F.lit("").alias("hash"))
    found = freshness.locate_blocks(blocks, _lines(spark, base), index(spark, base)["symbols"])
    return found.select("block_id", F.col("at.start").alias("first_line"), F.col("at.end").alias("last_line"))


@query(
    "uncovered_functions",
    f"""WITH {INDEX_SQL}, code AS (SELECT * FROM sym WHERE kind NOT IN ('type', 'class')),
w AS (SELECT * FROM code x WHERE NOT EXISTS (SELECT 1 FROM code y WHERE y.file = x.file AND y.start_line <= x.start_line AND y.end_line >= x.end_line AND (y.start_line < x.start_line OR y.end_line > x.end_line)))
SELECT n_nationkey AS scope, name FROM nation JOIN w ON w.file = 'd' || n_nationkey WHERE CAST(substr(name, 2) AS INTEGER) % 3 <> n_nationkey % 3""",
)
def uncovered_functions(spark, base):
    """Functions of a file that its explanation does not cover."""
    scopes = table(spark, base, "nation").select(F.col("n_nationkey").alias("scope"), _d(F.col("n_nationkey")).alias("file"))
    symbols = index(spark, base)["symbols"]
    covered = scopes.join(symbols, "file").where(F.substring("name", 2, 9).cast("int") % 3 == F.col("scope") % 3).select("scope", "name").distinct()
    return freshness.uncovered(scopes, covered, symbols)


@query(
    "content_hashes",
    """SELECT conv_id AS scope, sha256(string_agg('s' || conv_id || '#' || CASE WHEN turn % 2 = 0 THEN 'f' || turn ELSE turn || '-' || (turn + 4) END || ':' || role, chr(10) ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id""",
)
def content_hashes(spark, base):
    """Digests over the blocks of a scope in order."""
    turn = F.col("turn").cast("int")
    blocks = table(spark, base, "conversations").select(
        F.col("conv_id").alias("scope"), turn.alias("position"), _numbered("s", F.col("conv_id")).alias("file"), F.when(turn % 2 == 0, _numbered("f", turn)).alias("symbol"), turn.alias("start"), (turn + 4).alias("end"), F.col("role").alias("hash")
    )
    return documents.content_hashes(blocks)


@query("saved_dropped", "SELECT event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) > 1")
def saved_dropped(spark, base):
    """The documents of a scope that a newer one replaces."""
    saved = table(spark, base, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("ref"), F.col("event_id").alias("id"))
    return documents.drop_older(saved)[1]


@query("scope_questions", "SELECT event_id AS id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS position FROM events WHERE user_id % 4 = 1")
def scope_questions(spark, base):
    """Questions of some scopes, oldest first."""
    asked = table(spark, base, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("ref"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return documents.questions_of(asked, asked.where("ref % 4 = 1")).select("id", "position")


@query("frontend_calls", f"WITH {INDEX_SQL} SELECT caller_id, call_line, count(*) AS n FROM calls WHERE starts_with('web/' || file, 'web/d1') AND starts_with('web/' || file || '/x', 'web/d1/') GROUP BY ALL")
def frontend_calls(spark, base):
    """Calls of files under a root, by whole path segments."""
    calls = index(spark, base)["calls"].withColumn("file", F.concat(F.lit("web/"), "file", F.lit("/x")))
    return walkthroughs.frontend_calls(calls, "./web/d1/").groupBy("caller_id", "call_line").agg(F.count("*").alias("n"))


@query(
    "index_stats",
    f"""WITH {INDEX_SQL} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM calls) AS calls, (SELECT count(*) FROM calls WHERE NOT resolved) AS unresolved""",
)
def index_stats(spark, base):
    return contexts.index_stats(index(spark, base))


@query(
    "unmatched_owners",
    f"""WITH {INDEX_SQL}, k AS (SELECT symbol_id FROM sym WHERE start_line % 7 <> 0), o AS (SELECT 'calls' AS t, caller_id AS id FROM calls UNION ALL SELECT 'side_effects', 'p' || o_custkey FROM orders UNION ALL SELECT 'api_calls', 'p' || (s_suppkey * 7 + 1) FROM supplier)
SELECT t, count(*) AS n FROM o WHERE id NOT IN (SELECT symbol_id FROM k) GROUP BY t""",
)
def unmatched_owners(spark, base):
    """Facts whose symbol is not there, which a load must not have."""
    found = index(spark, base)
    effects = table(spark, base, "orders").select(_numbered("p", F.col("o_custkey")).alias("symbol_id"))
    api = table(spark, base, "supplier").select(_numbered("p", F.col("s_suppkey") * 7 + 1).alias("symbol_id"))
    tables = found | {"side_effects": effects, "api_calls": api, "components": found["symbols"].where("start_line % 7 <> 0")}
    return facts.missing_owners(tables, found["symbols"].where("start_line % 7 <> 0").select("symbol_id"))


@query(
    "fn_context",
    f"""WITH {INDEX_SQL}, sp AS (SELECT n_nationkey AS target, 'd' || (n_nationkey % 50) AS file, n_nationkey * 7 % 300 + 1 AS a, n_nationkey * 7 % 300 + 61 AS b FROM nation),
o AS (SELECT target, symbol_id, exported FROM sp JOIN sym USING (file) WHERE start_line >= a AND end_line <= b AND kind NOT IN ('type', 'class')),
one AS (SELECT DISTINCT target, caller_id, callee_id, callee_text, call_line FROM o JOIN calls ON caller_id = symbol_id JOIN sp USING (target) WHERE call_line BETWEEN a AND b AND (target, callee_id) NOT IN (SELECT (target, symbol_id) FROM o)),
callee AS (SELECT target, 'callee' AS part, s.file, s.start_line AS first_line FROM one JOIN sym s ON s.symbol_id = callee_id WHERE kind NOT IN ('type', 'class')),
caller AS (SELECT target, 'caller' AS part, c.file, greatest(c.start_line, call_line - 2) AS first_line FROM o JOIN calls ON callee_id = o.symbol_id JOIN sym c ON c.symbol_id = caller_id JOIN sp USING (target)
  WHERE o.exported AND NOT (c.file = sp.file AND c.start_line >= a AND c.end_line <= b)),
every AS (SELECT target, 'target' AS part, file, a AS first_line FROM sp UNION ALL SELECT * FROM callee UNION ALL SELECT * FROM caller)
SELECT target, part, file, CAST(first_line AS INTEGER) AS first_line, count(*) AS n FROM every GROUP BY ALL""",
)
def fn_context(spark, base):
    """What the context of a function shows: the target, bodies of direct callees and call sites."""
    s = F.col("n_nationkey")
    first = (s * 7 % 300 + 1).cast("int")
    targets = table(spark, base, "nation").select(s.alias("target"), _d(s % 50).alias("file"), F.lit(None).cast("string").alias("symbol"), first.alias("start"), (first + 60).cast("int").alias("end"))
    long = _lines(spark, base).select("file", F.array_repeat(F.lit("x"), 600).alias("lines"))
    none = spark.createDataFrame([], "file string, kind string, name string, line int, ref_file string, ref_line int, ref_end_line int")
    code = contexts.fn_context(index(spark, base) | {"declarations": none}, long, targets, 2, 10**9)["code"]
    return code.where("fits").groupBy("target", "part", "file", F.col("start").alias("first_line")).agg(F.count("*").alias("n"))


@query(
    "merged_levels",
    """WITH o AS (SELECT o_custkey AS k, o_orderkey, CASE WHEN o_custkey % 13 = 3 THEN 3 WHEN o_custkey % 7 = 1 THEN 1 ELSE 0 END AS level FROM orders WHERE o_custkey % 11 <> 2 OR o_custkey % 13 = 3)
SELECT 'c' || k AS file, o_orderkey AS position, CAST(level AS INTEGER) AS level FROM o""",
)
def merged_levels(spark, base):
    """Facts of files (customers, with an order each for a fact) after a first pass and three that change, remove and bring back some."""
    order, number = F.col("o_orderkey"), F.col("o_custkey")
    facts_of = lambda level, where: table(spark, base, "orders").where(where).select(_numbered("c", number).alias("file"), order.alias("position"), F.lit(level).alias("level"))
    files = lambda where: table(spark, base, "orders").where(where).select(_numbered("c", number).alias("file"))
    store = snapshot.SnapshotStore(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    store.publish({"imports": facts_of(0, F.lit(True))})
    store.change({"imports": facts_of(1, number % 7 == 1)}, {"imports": {"file": files(number % 7 == 1)}})
    store.change({}, {"imports": {"file": files(number % 11 == 2)}})
    return store.change({"imports": facts_of(3, number % 13 == 3)}, {"imports": {"file": files(number % 13 == 3)}})["imports"]
