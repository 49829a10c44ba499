"""The library's operators over ordinary tables, each with the SQL that gives the same rows.

Text-like operators run over pages, documents and conversations, graph operators
over links between parts, interval operators over events, and table maintenance
over orders and line items. All of them read their whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import freshness, graph, nesting, relational, routes, windows
from ..sources.tables import table
from .registry import query

LINES_SQL = r"""CASE WHEN len(string_split_regex(coalesce(text, ''), '\r?\n')) > 1 AND string_split_regex(coalesce(text, ''), '\r?\n')[-1] = ''
  THEN list_slice(string_split_regex(coalesce(text, ''), '\r?\n'), 1, -2) ELSE string_split_regex(coalesce(text, ''), '\r?\n') END"""

LOCAL_SQL = r"regexp_replace(regexp_replace(url, '^[a-z][a-z0-9+.-]*://[^/]*', '', 'i'), '[?#].*$', '')"
NORMAL_SQL = r"""CASE WHEN starts_with(l, '/') THEN
  CASE WHEN length(regexp_replace('/' || l, '/+', '/', 'g')) > 1 THEN regexp_replace(regexp_replace('/' || l, '/+', '/', 'g'), '/$', '') ELSE '/' END ELSE l END"""


def _page_paths(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages").select("page_id", paths.url_pattern(F.col("url")).alias("pattern"))


PATHS_SQL = f"p AS (SELECT page_id, {NORMAL_SQL} AS pattern FROM (SELECT page_id, {LOCAL_SQL} AS l FROM pages))"


@query("url_pattern", f"WITH {PATHS_SQL} SELECT page_id, pattern FROM p")
def url_pattern(spark, base):
    return _page_paths(spark, base)


@query(
    "route_segments",
    f"""WITH {PATHS_SQL}, s AS (SELECT page_id, list_filter(string_split(pattern, '/'), lambda x: x <> '') AS s FROM p)
SELECT page_id, CAST(len(s) AS INTEGER) AS n, CAST(unnest(range(len(s))) AS INTEGER) AS position, unnest(s) AS segment FROM s""",
)
def route_segments(spark, base):
    s = _page_paths(spark, base).select("page_id", paths.segments(F.col("pattern")).alias("s"))
    return s.select("page_id", F.size("s").alias("n"), F.posexplode("s").alias("position", "segment"))


#: A small route table: (id, method, path).
ROUTES = [
    (1, "GET", "/en/:id"), (2, "GET", "/:lang/825"), (3, "ALL", "/de/:id"), (4, "GET", "/de/:id"), (5, "GET", "/api/en/:id"), (6, "POST", "/fr/:id"),
    (7, "GET", "/:a/:b"), (8, "GET", "*"), (9, "ALL", "/fr/:id"), (10, "GET", "/es/217"), (11, "GET", "/es/:id"), (12, "GET", "/site/:lang/:id"),
]
ROUTES_SQL = "r(route_id, method, full_path) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{m}', '{p}')" for i, m, p in ROUTES) + ")"
#: Calls alternate between a known method, an unknown one and a suffix of the path.
CALL_METHOD_SQL = "CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'UNKNOWN' ELSE 'POST' END"


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "route_id long, method string, full_path string")


def _calls(spark: SparkSession, base: str) -> DataFrame:
    method = F.when(F.col("page_id") % 3 == 0, "GET").when(F.col("page_id") % 3 == 1, "UNKNOWN").otherwise("POST")
    return _page_paths(spark, base).select(F.col("page_id").alias("call_id"), method.alias("method"), F.col("pattern").alias("url_pattern"))


SEGMENTS_SQL = "list_filter(string_split({}, '/'), lambda x: x <> '')"
EDGES_SQL = f"""{PATHS_SQL}, {ROUTES_SQL},
c AS (SELECT page_id AS call_id, {CALL_METHOD_SQL} AS m, {SEGMENTS_SQL.format("pattern")} AS w FROM p),
h AS (SELECT *, {SEGMENTS_SQL.format("full_path")} AS h FROM r),
pairs AS (
  SELECT call_id, m, route_id, method, full_path, w, h, CASE WHEN len(h) = len(w) THEN h ELSE list_slice(h, len(h) - len(w) + 1, len(h)) END AS t
  FROM c JOIN h ON (m = 'UNKNOWN' OR method = m OR method = 'ALL') AND (len(h) = len(w) OR (len(w) > 0 AND len(h) > len(w)))
), k AS (
  SELECT *, list_transform(list_zip(t, w), lambda z: CASE
    WHEN (starts_with(z[1], ':') OR z[1] = '*') AND starts_with(z[2], ':') THEN 'both' WHEN starts_with(z[1], ':') OR z[1] = '*' THEN 'param'
    WHEN NOT starts_with(z[2], ':') AND z[1] = z[2] THEN 'literal' ELSE 'none' END) AS z FROM pairs
), g AS (
  SELECT *, CASE WHEN list_contains(z, 'none') THEN NULL WHEN list_contains(t, '*') OR (list_contains(z, 'param') AND NOT list_contains(z, 'literal')) THEN 'wildcard'
    WHEN list_contains(z, 'param') THEN 'param' ELSE 'exact' END AS raw FROM k
), kind AS (
  SELECT *, CASE WHEN len(h) = len(w) THEN raw WHEN raw IN ('exact', 'param') THEN 'suffix' END AS kind FROM g
), edges AS (
  SELECT call_id, route_id, full_path, method, CASE WHEN m = 'UNKNOWN' THEN 'method' ELSE kind END AS match,
    CASE WHEN m = 'UNKNOWN' THEN least(b, 0.5) WHEN method = 'ALL' THEN round(b - 0.05, 2) ELSE b END AS confidence
  FROM (SELECT *, CAST(CASE kind WHEN 'exact' THEN 1.0 WHEN 'param' THEN 0.9 ELSE 0.6 END AS DOUBLE) AS b FROM kind WHERE kind IS NOT NULL)
)"""


@query("cross_edges", f"WITH {EDGES_SQL} SELECT call_id, route_id, match, confidence FROM edges")
def cross_edges(spark, base):
    return routes.candidates(_calls(spark, base), _routes(spark)).select("call_id", "route_id", "match", "confidence")


@query(
    "cross_edges_resolved",
    f"""WITH {EDGES_SQL}, o AS (
  SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS nx FROM edges WINDOW w AS (PARTITION BY call_id ORDER BY confidence DESC, full_path, method, route_id)
) SELECT call_id, route_id, match, confidence FROM o WHERE n = 1 AND confidence >= 0.9 AND (nx IS NULL OR nx < confidence)""",
)
def cross_edges_resolved(spark, base):
    return routes.cross_edges(_calls(spark, base), _routes(spark)).where("resolved").select("call_id", "route_id", "match", "confidence")


def _requests(spark: SparkSession, base: str) -> DataFrame:
    method = F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST")
    return _page_paths(spark, base).select(F.col("page_id").alias("request_id"), method.alias("method"), F.col("pattern").alias("path"))


FITS_SQL = "(z[1] = '*' OR (starts_with(z[1], ':') AND length(z[2]) > 0) OR z[1] = z[2])"
REQUESTS_SQL = f"""{PATHS_SQL}, {ROUTES_SQL},
q AS (SELECT page_id AS request_id, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS m, pattern AS path, {SEGMENTS_SQL.format("pattern")} AS w FROM p),
h AS (SELECT *, {SEGMENTS_SQL.format("full_path")} AS h FROM r)"""


@query(
    "route_match",
    f"""WITH {REQUESTS_SQL}, f AS (
  SELECT request_id, route_id, CASE WHEN full_path = path THEN 0 ELSE 2 END + CASE WHEN method = m THEN 0 ELSE 1 END AS tier
  FROM q JOIN h ON method IN (m, 'ALL') AND (full_path = path OR (len(h) = len(w) AND len(list_filter(list_zip(h, w), lambda z: NOT {FITS_SQL})) = 0))
) SELECT request_id, route_id, CAST(tier AS INTEGER) AS tier FROM f QUALIFY tier = min(tier) OVER (PARTITION BY request_id)""",
)
def route_match(spark, base):
    return routes.match_requests(_requests(spark, base), _routes(spark))


@query(
    "closest_routes",
    f"""WITH {REQUESTS_SQL}, f AS (
  SELECT request_id, route_id, full_path, len(list_filter(list_zip(h, w), lambda z: z[1] IS NOT NULL AND z[2] IS NOT NULL AND {FITS_SQL})) + CASE WHEN method IN (m, 'ALL') THEN 0.5 ELSE 0 END AS score FROM q, h
) SELECT request_id, CAST(row_number() OVER w AS INTEGER) AS position, route_id, CAST(score AS DOUBLE) AS score FROM f WHERE score > 0
WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, full_path, route_id) QUALIFY row_number() OVER w <= 5""",
)
def closest_routes(spark, base):
    return routes.closest_routes(_requests(spark, base), _routes(spark))


# --- graphs: every part links to two others, every event of a user to a number ------------------------


def _part_edges(spark: SparkSession, base: str, both: bool = True) -> DataFrame:
    p = table(spark, base, "part")
    first = ((F.col("p_partkey") * 7 + F.col("p_size")) % 500).cast("long")
    second = ((F.col("p_partkey") * 3 + 1) % 500).cast("long")
    targets = F.array(first, second) if both else F.array(first)
    return p.select(F.col("p_partkey").alias("src"), F.explode(targets).alias("dst"))


PART_EDGES_SQL = "e AS (SELECT DISTINCT p_partkey AS src, unnest([(p_partkey * 7 + p_size) % 500, (p_partkey * 3 + 1) % 500]) AS dst FROM part)"


def _user_edges(spark: SparkSession, base: str) -> DataFrame:
    target = ((F.col("user_id") * 7 + F.floor("value")) % 150).cast("long")
    return table(spark, base, "events").select(F.col("user_id").alias("src"), target.alias("dst")).distinct()


USER_EDGES_SQL = "e AS (SELECT DISTINCT user_id AS src, CAST((user_id * 7 + floor(value)) % 150 AS BIGINT) AS dst FROM events)"


@query(
    "reach_multi_root",
    f"""WITH RECURSIVE {USER_EDGES_SQL}, f(root, node, depth) AS (
  SELECT src, dst, 1 FROM e UNION SELECT f.root, e.dst, f.depth + 1 FROM f JOIN e ON e.src = f.node WHERE f.depth < 3
) SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM f GROUP BY root, node""",
)
def reach_multi_root(spark, base):
    edges = _user_edges(spark, base)
    return graph.reach(edges, edges.select("src"), 3)


@query(
    "callee_paths",
    """WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * 7 + p_size) % 500 AS dst FROM part), f(root, depth, src, dst, seen, going) AS (
  SELECT src, 1, src, dst, [src, dst], dst <> src FROM e
  UNION ALL SELECT f.root, f.depth + 1, e.src, e.dst, list_append(f.seen, e.dst), NOT list_contains(f.seen, e.dst) FROM f JOIN e ON e.src = f.dst WHERE f.going AND f.depth < 4
) SELECT root, CAST(depth AS INTEGER) AS depth, src, dst FROM f""",
)
def callee_paths(spark, base):
    edges = _part_edges(spark, base, both=False)
    return graph.callees(edges, edges.select("src"), 4)


@query("direct_callers", f"WITH {USER_EDGES_SQL} SELECT dst AS callee, array_to_string(list_sort(list_distinct(list(CAST(src AS VARCHAR)))), ',') AS callers FROM e GROUP BY dst")
def direct_callers(spark, base):
    rows = _user_edges(spark, base).select(F.col("dst").alias("callee"), F.array(F.col("src").cast("string")).alias("callers"))
    return relational.grouped_names(rows, "callee", "callers").select("callee", F.array_join("callers", ",").alias("callers"))


@query(
    "shortest_path",
    f"""WITH RECURSIVE {PART_EDGES_SQL}, f(root, node, path, n) AS (
  SELECT s_suppkey, e.dst, [s_suppkey, e.dst], 1 FROM supplier JOIN e ON e.src = s_suppkey WHERE e.dst <> s_suppkey
  UNION ALL SELECT f.root, e.dst, list_append(f.path, e.dst), f.n + 1 FROM f JOIN e ON e.src = f.node WHERE f.n < 5 AND NOT list_contains(f.path, e.dst)
), b AS (SELECT root, node, path, row_number() OVER (PARTITION BY root, node ORDER BY n, path) AS k FROM f)
SELECT root, node, array_to_string(path, '>') AS path FROM b WHERE k = 1""",
)
def shortest_path(spark, base):
    roots = table(spark, base, "supplier").select("s_suppkey")
    found = graph.shortest_paths(_part_edges(spark, base), roots, 5)
    return found.select("root", "node", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


@query(
    "reverse_reach",
    f"""WITH RECURSIVE {PART_EDGES_SQL}, stops AS (SELECT p_partkey AS n FROM part WHERE p_size > 10), f(start, node, hops) AS (
  SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION
  SELECT f.start, e.src, f.hops + 1 FROM f JOIN e ON e.dst = f.node WHERE f.hops < 8 AND f.node NOT IN (SELECT n FROM stops)
) SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM f GROUP BY start, node""",
)
def reverse_reach(spark, base):
    stops = table(spark, base, "part").where("p_size > 10").select("p_partkey")
    return graph.closest_reaching(_part_edges(spark, base), table(spark, base, "supplier").select("s_suppkey"), stops, 8)


@query(
    "mutual_reach_scc",
    f"""WITH RECURSIVE {PART_EDGES_SQL}, f(a, b) AS (SELECT src, dst FROM e WHERE dst < 500 AND src < 500 UNION SELECT f.a, e.dst FROM f JOIN e ON e.src = f.b)
SELECT x.a AS node, min(x.b) AS component FROM f x JOIN f y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(*) > 1""",
)
def mutual_reach_scc(spark, base):
    return graph.strong_components(_part_edges(spark, base))


# --- text --------------------------------------------------------------------------------------------


@query(
    "greedy_budget",
    """WITH RECURSIVE d AS (SELECT source, doc_id, ceil(length(text) / 4.0) + 10 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL),
f AS (
  SELECT source, doc_id, cost, n, cost <= 2000 AS taken, CASE WHEN cost <= 2000 THEN 2000 - cost ELSE 2000 END AS remaining FROM d WHERE n = 1
  UNION ALL SELECT d.source, d.doc_id, d.cost, d.n, d.cost <= f.remaining, CASE WHEN d.cost <= f.remaining THEN f.remaining - d.cost ELSE f.remaining END FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1
) SELECT source, doc_id, CAST(cost AS BIGINT) AS cost FROM f WHERE taken""",
)
def greedy_budget(spark, base):
    docs = table(spark, base, "documents").where("text is not null")
    return relational.greedy_budget(docs, ["source"], ["doc_id"], 2000, text="text", key="doc_id")


@query("line_hash", f"WITH l AS (SELECT doc_id, {LINES_SQL} AS l FROM documents) SELECT doc_id, CAST(len(l) AS INTEGER) AS n_lines, sha256(array_to_string(list_slice(l, 1, 3), chr(10))) AS head_hash, sha256(array_to_string(l, chr(10))) AS hash FROM l")
def line_hash(spark, base):
    lines = table(spark, base, "documents").select("doc_id", text.split_lines(F.coalesce("text", F.lit(""))).alias("l"))
    return lines.select("doc_id", F.size("l").alias("n_lines"), text.hash_lines(F.slice("l", 1, 3)).alias("head_hash"), text.hash_lines(F.col("l")).alias("hash"))


def _document_lines(spark: SparkSession, base: str) -> DataFrame:
    lines = table(spark, base, "documents").select("doc_id", F.posexplode(text.split_lines(F.coalesce("text", F.lit("")))).alias("at", "line_text"))
    return lines.where(relational.relocatable(F.col("line_text"))).select("doc_id", (F.col("at") + 1).alias("line"), "line_text")


@query(
    "nearest_match",
    f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS l FROM documents), x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM l),
y AS (SELECT * FROM x WHERE regexp_matches(t, '[A-Za-z_$]')), first AS (SELECT t, min(doc_id) AS d FROM y GROUP BY t),
o AS (SELECT y.* FROM y JOIN first f ON f.t = y.t AND f.d = y.doc_id)
SELECT y.doc_id, CAST(y.line AS INTEGER) AS line, CAST(arg_min(o.line, abs(o.line - y.line) * 1000000 + o.line) AS INTEGER) AS found
FROM y JOIN o ON o.t = y.t WHERE y.doc_id <> o.doc_id GROUP BY y.doc_id, y.line""",
)
def nearest_match(spark, base):
    """Lines that the first document with the same line also has, and the nearest of them there."""
    lines = _document_lines(spark, base)
    first = relational.first_value(lines, ["line_text"], F.col("doc_id"), ["doc_id"]).withColumnRenamed("doc_id", "first")
    placed = lines.join(first, "line_text")
    asked = placed.where("doc_id <> first").select("line_text", F.struct("doc_id", "line").alias("id"), F.col("line").alias("near"))
    found = relational.nearest_match(asked, placed.where("doc_id = first").select("line_text", "line"), ["line_text"])
    return found.select("id.doc_id", "id.line", F.col("line").cast("int").alias("found"))


@query(
    "block_relocate",
    f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS l FROM documents), b AS (SELECT doc_id, l, sha256(array_to_string(list_slice(l, 2, 3), chr(10))) AS h FROM l WHERE len(l) >= 3),
w AS (SELECT doc_id, unnest(range(1, len(l))) AS pos, l, h FROM b), m AS (SELECT doc_id, pos FROM w WHERE sha256(array_to_string(list_slice(l, pos, pos + 1), chr(10))) = h)
SELECT doc_id, CAST(arg_min(pos, abs(pos - 1) * 1000000 + pos) AS INTEGER) AS line FROM m GROUP BY doc_id""",
)
def block_relocate(spark, base):
    """Where the second and third line of a document stand nearest to its top."""
    docs = table(spark, base, "documents").select("doc_id", text.split_lines(F.coalesce("text", F.lit(""))).alias("l")).where("size(l) >= 3")
    return windows_of_pairs(docs, F.slice("l", 2, 2), docs.select(F.col("doc_id").alias("file"), F.col("l").alias("lines"))).select(F.col("id").alias("doc_id"), F.col("start").alias("line"))


def windows_of_pairs(docs, pair, sources):
    """(id, start): where a pair of lines saved of each document stands nearest to the top of the text of that number."""
    asked = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file"), F.lit(2).alias("length"), windows.block_print(pair).alias("print"), text.hash_lines(pair).alias("hash"), F.lit(1).alias("near"), F.lit(1).alias("first"), F.lit(2**31 - 1).alias("last"))
    return windows.find_windows(asked, sources)


IDENTIFIERS_SQL = r"regexp_extract_all(regexp_replace({}, '\\.', ' ', 'g'), '[A-Za-z_$][A-Za-z0-9_$]*')"


@query("identifiers", f"SELECT doc_id, CAST(len(list_distinct({IDENTIFIERS_SQL.format('text')})) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def identifiers(spark, base):
    return table(spark, base, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(text.identifiers(F.col("text")))).alias("n"))


@query(
    "vocabulary_unknown",
    f"""WITH v AS (SELECT DISTINCT unnest({IDENTIFIERS_SQL.format("text")}) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({IDENTIFIERS_SQL.format("text")})) AS w FROM documents)
SELECT doc_id, count(*) AS unknown FROM d WHERE w NOT IN (SELECT w FROM v WHERE w IS NOT NULL) GROUP BY doc_id""",
)
def vocabulary_unknown(spark, base):
    known = table(spark, base, "benchmark").select(F.explode(text.identifiers(F.col("text"))).alias("w")).distinct()
    words = table(spark, base, "documents").select("doc_id", F.explode(F.array_distinct(text.identifiers(F.col("text")))).alias("w"))
    return words.join(known, "w", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))


@query("first_occurrence", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_occurrence(spark, base):
    docs = table(spark, base, "documents").where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("hash")


@query(
    "question_outdated",
    """SELECT conv_id * 1000 + turn AS question_id, l.doc_id IS NULL OR l.quality <> turn % 2 OR turn < l.toxic * 3 AS outdated FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id""",
)
def question_outdated(spark, base):
    """Questions about steps that are gone, have other lines now, or were explained later."""
    steps = table(spark, base, "labels").select(F.lit("all").alias("scope"), F.col("doc_id").alias("step_id"), F.col("quality").cast("string").alias("hash"), (F.col("toxic") * 3).alias("generated_at"))
    turn = F.col("turn")
    asked = table(spark, base, "conversations").select((F.col("conv_id") * 1000 + turn).alias("question_id"), F.lit("all").alias("scope"), F.col("conv_id").alias("step_id"), (turn % 2).cast("string").alias("step_hash"), turn.alias("created_at"))
    return freshness.question_outdated(asked, steps)


# --- intervals ---------------------------------------------------------------------------------------

SPANS_SQL = "s AS (SELECT event_id AS id, user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS a, CAST(floor(epoch(ts) / 60) AS BIGINT) + CAST(floor(value) AS BIGINT) % 30 AS b FROM events)"


def _spans(spark: SparkSession, base: str) -> DataFrame:
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    return table(spark, base, "events").select(F.col("event_id").alias("id"), "user_id", minute.alias("start"), (minute + F.floor("value").cast("long") % 30).alias("end"))


@query(
    "merge_ranges",
    f"""WITH {SPANS_SQL}, m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM s),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS "start", max(b) AS "end" FROM i GROUP BY user_id, g""",
)
def merge_ranges(spark, base):
    return relational.merge_ranges(_spans(spark, base), ["user_id"])


@query("range_overlap", f"WITH {SPANS_SQL} SELECT x.user_id, x.id AS l_id, y.id AS r_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.a <= y.b AND x.b >= y.a WHERE x.id < y.id")
def range_overlap(spark, base):
    spans = _spans(spark, base)
    return relational.overlap_join(spans, spans, ["user_id"], 60).where("l_id < r_id")


@query(
    "innermost_enclosing",
    f"""WITH {SPANS_SQL} SELECT x.id, arg_min(y.id, (-y.a, y.b, y.id)) AS span_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.b BETWEEN y.a AND y.b GROUP BY x.id""",
)
def innermost_enclosing(spark, base):
    spans = _spans(spark, base)
    return nesting.holding(spans.select("id", "user_id", F.col("end").alias("at")), spans, ["user_id"])


@query(
    "nested_filter",
    f"WITH {SPANS_SQL} SELECT id, user_id FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.a <= x.a AND y.b >= x.b AND (y.a < x.a OR y.b > x.b))",
)
def nested_filter(spark, base):
    return relational.outermost(_spans(spark, base), ["user_id"]).select("id", "user_id")


# --- maintenance -------------------------------------------------------------------------------------


@query(
    "change_detection",
    """WITH o AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents), n AS (SELECT doc_id + 7 AS doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""",
)
def change_detection(spark, base):
    """All documents against themselves under keys that moved by seven: some are new, some gone, most altered."""
    docs = table(spark, base, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return relational.changes(docs, docs.select((F.col("doc_id") + 7).alias("doc_id"), "h"), "doc_id", "h")


@query(
    "dependents",
    """WITH t AS (SELECT p_partkey FROM part WHERE p_size = 1), hit AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM t))
SELECT l_orderkey FROM hit WHERE l_orderkey NOT IN (SELECT p_partkey FROM t)""",
)
def dependents(spark, base):
    touched = table(spark, base, "part").where("p_size = 1").select("p_partkey")
    return relational.dependents(table(spark, base, "lineitem").select("l_orderkey", "l_partkey"), touched, "l_orderkey", "l_partkey")


@query(
    "upsert_keep_time",
    """WITH o AS (SELECT user_id, event_type, arg_max(CAST(floor(value) AS BIGINT) % 3, (ts, event_id)) AS v, max(ts) AS t FROM events GROUP BY ALL),
n AS (SELECT user_id + 1 AS user_id, event_type, v, t FROM o)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type) AS event_type, CASE WHEN n.user_id IS NULL THEN o.v ELSE n.v END AS v,
  CAST(epoch_us(CASE WHEN n.user_id IS NULL OR (o.user_id IS NOT NULL AND o.v IS NOT DISTINCT FROM n.v) THEN o.t ELSE n.t END) AS BIGINT) AS t_us
FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""",
)
def upsert_keep_time(spark, base):
    """The latest event of each user and type, written over by those of the user before."""
    events = table(spark, base, "events")
    old = events.groupBy("user_id", "event_type").agg(F.max_by(F.floor("value").cast("long") % 3, F.struct("ts", "event_id")).alias("v"), F.max("ts").alias("t"))
    done = relational.upsert(old, old.withColumn("user_id", F.col("user_id") + 1), ["user_id", "event_type"], "v", "t")
    return done.select("user_id", "event_type", "v", F.unix_micros(F.col("t").cast("timestamp")).alias("t_us"))


@query("newest_of_scope", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def newest_of_scope(spark, base):
    return relational.first_value(table(spark, base, "events"), ["user_id", "event_type"], -F.col("event_id"), ["event_id", "value"])


@query(
    "importers_agg",
    """SELECT p_partkey, coalesce(array_to_string(list_sort(list_distinct(list(l_returnflag) FILTER (l_returnflag IS NOT NULL))), ','), '') AS flags FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
)
def importers_agg(spark, base):
    none = F.array().cast("array<string>")
    # the set of each part combines before it is moved
    flags = table(spark, base, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.array("l_returnflag").alias("flags"))
    rows = flags.unionByName(table(spark, base, "part").select("p_partkey", none.alias("flags")))
    known = relational.grouped_names(rows, "p_partkey", "flags").join(table(spark, base, "part").select("p_partkey"), "p_partkey", "left_semi")
    return known.select("p_partkey", F.array_join("flags", ",").alias("flags"))


@query("exists_flag", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def exists_flag(spark, base):
    returned = table(spark, base, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.exists_flag(table(spark, base, "orders").select("o_orderkey"), returned, "o_orderkey", "returned")


@query(
    "key_resolution",
    """SELECT o_orderkey, c.c_custkey AS customer, o_orderstatus <> 'P' AND (o_custkey % 10 = 0 OR c.c_custkey IS NOT NULL) AS resolved
FROM orders LEFT JOIN customer c ON c.c_custkey = CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey + o_orderkey % 3 * 50 END""",
)
def key_resolution(spark, base):
    """Keys that may be absent or lead nowhere; resolved if the source says so and a given key was found."""
    given = F.when(F.col("o_custkey") % 10 == 0, None).otherwise(F.col("o_custkey") + F.col("o_orderkey") % 3 * 50).cast("long")
    orders = table(spark, base, "orders").select("o_orderkey", "o_orderstatus", given.alias("key"))
    customers = table(spark, base, "customer").select(F.col("c_custkey").alias("customer"))
    joined = orders.join(customers, F.col("key") == F.col("customer"), "left")
    return joined.select("o_orderkey", "customer", ((F.col("o_orderstatus") != "P") & (F.col("key").isNull() | F.col("customer").isNotNull())).alias("resolved"))


@query("json_key", "SELECT CAST(props ->> 'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_key(spark, base):
    return table(spark, base, "events").groupBy(F.get_json_object("props", "$.k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))
