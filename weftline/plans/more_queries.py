"""Further operators over ordinary tables: parsing, digests, cascades, semi-joins, freshness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import documents, freshness, graph, relational, windows
from ..sources.tables import table
from .registry import query
from .table_queries import LINES_SQL, windows_of_pairs


@query(
    "request_parse",
    r"""WITH t AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' get  ' WHEN 1 THEN 'POST ' ELSE 'FETCH ' END || regexp_replace(url, '^[a-z]+://[^/]*', '') AS t FROM pages),
m AS (SELECT page_id, upper(regexp_extract(t, '^\s*([A-Za-z]+)\s+(\S+)\s*$', 1)) AS m, regexp_replace(regexp_extract(t, '^\s*([A-Za-z]+)\s+(\S+)\s*$', 2), '[?#].*$', '') AS p FROM t)
SELECT page_id, CASE WHEN m IN ('GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'OPTIONS', 'HEAD', 'ALL') THEN m END AS method,
  CASE WHEN starts_with(p, '/') THEN CASE WHEN length(regexp_replace('/' || p, '/+', '/', 'g')) > 1 THEN regexp_replace(regexp_replace('/' || p, '/+', '/', 'g'), '/$', '') ELSE '/' END END AS path FROM m""",
)
def request_parse(spark, base):
    """Request targets made of all page addresses, one method in three unknown."""
    verb = F.when(F.col("page_id") % 3 == 0, " get  ").when(F.col("page_id") % 3 == 1, "POST ").otherwise("FETCH ")
    asked = table(spark, base, "pages").select("page_id", F.concat(verb, F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("t"))
    return asked.select("page_id", paths.request_method(F.col("t")).alias("method"), paths.request_path(F.col("t")).alias("path"))


@query("token_estimate", "SELECT doc_id, CAST(ceil((length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, base):
    """Characters beyond the basic plane count twice, as in UTF-16."""
    return table(spark, base, "documents").where("text is not null").select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


@query("document_slugs", r"SELECT page_id, 'page--' || substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || '--' || substr(sha256('page:' || url), 1, 8) AS slug FROM pages")
def document_slugs(spark, base):
    return table(spark, base, "pages").select("page_id", paths.document_slug(F.lit("page"), F.col("url")).alias("slug"))


@query(
    "source_lines",
    f"WITH l AS (SELECT doc_id, {LINES_SQL} AS l FROM documents), x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS t FROM l) SELECT doc_id, CAST(line AS INTEGER) AS line, sha256(t) AS hash FROM x",
)
def source_lines(spark, base):
    lines = table(spark, base, "documents").select("doc_id", F.posexplode(text.split_lines(F.coalesce("text", F.lit("")))).alias("at", "t"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line"), F.sha2(F.col("t").cast("binary"), 256).alias("hash"))


@query("ordered_digest", "SELECT user_id, sha256(string_agg(event_type || ' ' || event_id, chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY user_id")
def ordered_digest(spark, base):
    """A digest over each user's events in order, as over the entries of a chain."""
    rows = table(spark, base, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    return rows.select("user_id", text.digest(F.transform("r", lambda e: F.concat_ws(" ", e["event_type"], e["event_id"].cast("string")))).alias("digest"))


@query("position_numbers", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) - 1 AS INTEGER) AS position FROM lineitem")
def position_numbers(spark, base):
    return relational.number_rows(table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_orderkey"], ["l_shipdate", "l_linenumber"]).select("l_orderkey", "l_linenumber", "position")


@query("keep_first", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def keep_first(spark, base):
    return relational.first_value(table(spark, base, "events"), ["user_id"], F.struct("ts", "event_id"), ["event_id", "event_type"])


@query(
    "cascade_delete",
    """WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0), o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT o_orderkey, count(l_orderkey) AS items FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def cascade_delete(spark, base):
    """Customers in debt go, with them their orders, with these their items."""
    customers, items = table(spark, base, "customer"), table(spark, base, "lineitem")
    # orders of customers that do not exist go as well
    known = table(spark, base, "orders").select("o_orderkey", "o_custkey").join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    tables = {"orders": known, "items": items.select("l_orderkey", "l_linenumber")}
    left = relational.cascade(customers.where("c_acctbal < 0").select("c_custkey"), tables, [("orders", "o_custkey", "o_orderkey"), ("items", "l_orderkey", None)])
    counted = left["items"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    return left["orders"].join(counted, "o_orderkey", "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"))


@query(
    "lateral_members",
    """WITH s AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(url, '[a-z]+'))) AS w FROM pages), k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
SELECT page_id, count(*) AS hits FROM s SEMI JOIN k ON s.w = k.w GROUP BY page_id""",
)
def lateral_members(spark, base):
    """Elements of nested lists that a key table names."""
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))
    members = table(spark, base, "pages").select("page_id", F.explode(F.array_distinct(words(F.col("url")))).alias("w"))
    keys = table(spark, base, "benchmark").select(F.explode(words(F.lower("text"))).alias("w")).distinct()
    return relational.within(members, keys, "w").groupBy("page_id").agg(F.count("*").alias("hits"))


@query(
    "ordered_union",
    """WITH u AS (SELECT part.p_brand AS k, 1 AS src, p_partkey AS n, p_size AS v FROM part UNION ALL SELECT p_brand, 2, p_partkey, p_size + 100 FROM part WHERE p_retailprice > 1000)
SELECT k, CAST(arg_max(v, (src, n)) AS INTEGER) AS v, CAST(min(src) AS INTEGER) AS first_source FROM u GROUP BY k""",
)
def ordered_union(spark, base):
    """Two sources in order: a key keeps its first place and its last value."""
    parts = table(spark, base, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("n"), F.col("p_size").alias("v"), "p_retailprice")
    dear = parts.where("p_retailprice > 1000").withColumn("v", F.col("v") + 100)
    return relational.last_of_sources([parts, dear], "k", "v", "n")


@query(
    "in_list_effects",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))""",
)
def in_list_effects(spark, base):
    """Rows whose owner is on a list that a query gives."""
    customers = table(spark, base, "customer").select("c_custkey", "c_mktsegment")
    least = customers.agg(F.min("c_mktsegment").alias("c_mktsegment"))
    listed = customers.join(least, "c_mktsegment", "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return relational.within(table(spark, base, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), listed, "o_custkey")


@query(
    "section_freshness",
    f"""WITH d AS (SELECT doc_id, {LINES_SQL} AS l FROM documents), n AS (SELECT doc_id - 1 AS doc_id, l AS now FROM d),
s AS (SELECT d.doc_id, l, now FROM d JOIN n ON d.doc_id = n.doc_id WHERE len(l) >= 2),
k AS (SELECT doc_id, now, sha256(l[1] || chr(10) || l[2]) AS h FROM s), p AS (SELECT doc_id, unnest(range(1, len(now))) AS pos, now, h FROM k),
f AS (SELECT doc_id, min(pos) AS at FROM p WHERE sha256(now[pos] || chr(10) || now[pos + 1]) = h GROUP BY doc_id)
SELECT s.doc_id, f.at IS NOT NULL AS fresh, CAST(f.at AS INTEGER) AS line FROM s LEFT JOIN f ON f.doc_id = s.doc_id""",
)
def section_freshness(spark, base):
    """Whether the first two lines of a document still stand in the next document, and where."""
    docs = table(spark, base, "documents").select("doc_id", text.split_lines(F.coalesce("text", F.lit(""))).alias("l"))
    now = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("l").alias("now"))
    joined = docs.where("size(l) >= 2").join(now, "doc_id")
    found = windows_of_pairs(joined, F.slice("l", 1, 2), now.select(F.col("doc_id").alias("file"), F.col("now").alias("lines")))
    return joined.select("doc_id").join(found.select(F.col("id").alias("doc_id"), F.col("start").alias("line")), "doc_id", "left").select("doc_id", F.col("line").isNotNull().alias("fresh"), "line")


@query(
    "question_ids",
    """SELECT conv_id, turn, CAST(10 + row_number() OVER (ORDER BY turn, conv_id) AS BIGINT) AS id FROM conversations""",
)
def question_ids(spark, base):
    """Ids that go on from the largest one there is, in a total order."""
    asked = table(spark, base, "conversations").select("conv_id", "turn")
    return relational.number_all(asked, ["turn", "conv_id"], 10).select("conv_id", "turn", "id")


@query("json_records", "SELECT event_id, CAST(props ->> 'k' AS INTEGER) AS k, json_exists(props, '$.k') AS given FROM events")
def json_records(spark, base):
    """Documents expanded to typed columns."""
    parsed = F.from_json("props", "k int")
    return table(spark, base, "events").select("event_id", parsed["k"].alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("given"))


@query(
    "documentation_links",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://node-postgres.com/apis/pool' WHEN 1 THEN 'https://github.com/' || 'a/b' || p_size
  WHEN 2 THEN 'https://www.npmjs.com/package/lib' || p_size || '/v/1.2.' || p_size ELSE 'https://zod.dev/api' END AS url FROM part""",
)
def documentation_links(spark, base):
    kind = F.col("p_partkey") % 4
    size = F.col("p_size").cast("string")
    package = F.when(kind == 0, "pg").when(kind == 3, "zod").otherwise(F.concat(F.lit("lib"), size))
    repository = F.when(kind == 1, F.concat(F.lit("git+https://github.com/a/b"), size, F.lit(".git")))
    found = documents.documentation_url(package, F.lit("Pool"), F.when(kind == 2, F.concat(F.lit("1.2."), size)), package, F.lit(None).cast("string"), repository)
    return table(spark, base, "part").select("p_partkey", found["url"].alias("url"))


@query(
    "locale_order",
    """WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN '_' || p_name WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name END AS name FROM part)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_size ORDER BY name COLLATE en, name, p_partkey) AS INTEGER) AS position FROM t""",
)
def locale_order(spark, base):
    """Names in the order that readers expect: case and punctuation come after letters."""
    kind, name = F.col("p_partkey") % 5, F.col("p_name")
    name = F.when(kind == 0, F.upper(name)).when(kind == 1, F.concat(F.lit("_"), name)).when(kind == 2, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(name)
    place = F.row_number().over(Window.partitionBy("p_size").orderBy(*text.locale_order(F.col("name")), "p_partkey"))
    return table(spark, base, "part").withColumn("name", name).select("p_partkey", place.alias("position"))


@query(
    "redacted_urls",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'postgres://u' || page_id || ':***@' WHEN 1 THEN 'postgres://u' || page_id || '@' ELSE 'postgres://' END || substr(url, strpos(url, '//') + 2) AS url FROM pages""",
)
def redacted_urls(spark, base):
    """Addresses with a password that itself holds a colon and an at sign, with a user alone, and with neither."""
    page, kind = F.col("page_id"), F.col("page_id") % 3
    user = F.when(kind == 0, F.concat(F.lit("u"), page.cast("string"), F.lit(":p:w@d"), page.cast("string"), F.lit("@"))).when(kind == 1, F.concat(F.lit("u"), page.cast("string"), F.lit("@"))).otherwise("")
    url = F.concat(F.lit("postgres://"), user, F.expr("substr(url, instr(url, '//') + 2)"))
    return table(spark, base, "pages").select("page_id", paths.redacted_url(url).alias("url"))


BLOCKS_SQL = f"""d AS (SELECT doc_id, {LINES_SQL} AS l FROM documents),
s AS (SELECT doc_id, l, CASE doc_id % 3 WHEN 0 THEN list_concat(['// new'], l) WHEN 1 THEN l ELSE l[2:] END AS now FROM d WHERE len(l) >= 3),
w AS (SELECT doc_id, unnest(range(1, len(now) - 1)) AS p, now, l FROM s),
b AS (SELECT doc_id, arg_min(p, abs(p - 1) * 1000000 + p) AS hit FROM w WHERE now[p:p+2] = l[1:3] GROUP BY doc_id),
j AS (SELECT s.*, coalesce(hit, CASE WHEN len(now) >= 3 THEN 1 END) AS a, hit IS NOT NULL AS same FROM s LEFT JOIN b USING (doc_id)),
t AS (SELECT doc_id, arg_min(p, abs(p - a - 1) * 1000000 + p) AS line FROM (SELECT *, unnest(range(a, a + 3)) AS p FROM j WHERE a IS NOT NULL AND NOT same) WHERE now[p] = l[2] GROUP BY doc_id),
r AS (SELECT j.*, CASE WHEN same THEN a + 1 ELSE line END AS line FROM j LEFT JOIN t USING (doc_id))"""


def _moved(spark, base):
    """Blocks of three lines with a step on the second, saved of each document, and the documents as they are now."""
    docs = table(spark, base, "documents").select("doc_id", text.split_lines(F.coalesce("text", F.lit(""))).alias("l"))
    now = F.when(F.col("doc_id") % 3 == 0, F.concat(F.array(F.lit("// new")), "l")).when(F.col("doc_id") % 3 == 1, F.col("l")).otherwise(F.slice("l", F.lit(2), F.size("l")))
    own = lambda start, n, p: [text.hash_lines(F.slice("l", start, n)).alias(f"{p}hash"), windows.block_print(F.slice("l", start, n)).alias(f"{p}print"), F.lit(start).alias(f"{p}start"), F.lit(start + n - 1).alias(f"{p}end")]
    # what was saved is a table of its own, with digests for texts, so that joins of sections and steps read no document again
    saved = graph.settle(docs.select(F.col("doc_id").alias("section_id"), F.size("l").alias("n"), F.col("doc_id").cast("string").alias("file"), *own(1, 3, ""), *own(2, 1, "step_"))).where("n >= 3")
    blocks = saved.select("section_id", F.lit(0).alias("position"), "file", F.lit(None).cast("string").alias("symbol"), "hash", "print", "start", "end")
    steps = saved.select("section_id", F.lit("s").alias("step_id"), F.col("file").alias("step_file"), "step_hash", "step_print", "step_start", "step_end")
    return blocks, steps, docs.select(F.col("doc_id").cast("string").alias("file"), now.alias("lines"), text.hash_lines(now).alias("hash"))


@query("block_sections", f"WITH {BLOCKS_SQL} SELECT doc_id, CASE WHEN a IS NULL THEN 'missing' WHEN same THEN 'fresh' ELSE 'changed' END AS state, CAST(a AS INTEGER) AS first_line, a IS NOT NULL AND line IS NOT NULL AS step_fresh, CAST(coalesce(CASE WHEN a IS NOT NULL THEN line END, 2) AS INTEGER) AS step_line FROM r")
def block_sections(spark, base):
    """Whether sections of several blocks and their steps still stand, in documents that lines were added to or taken from."""
    blocks, steps, sources = _moved(spark, base)
    none = spark.createDataFrame([], "file string, name string, start_line int, end_line int")
    sections, judged = freshness.check_block_sections(blocks, steps, sources, none)
    joined = sections.join(judged.select("section_id", F.col("fresh").alias("step_fresh"), F.col("start").alias("step_line")), "section_id")
    return joined.select(F.col("section_id").alias("doc_id"), "state", F.col("at.start").alias("first_line"), "step_fresh", "step_line")


@query("reused_sections", f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(a - 1 AS INTEGER) AS delta FROM r WHERE same AND doc_id % 5 <> 0")
def reused_sections(spark, base):
    """Sections that can be kept by shifting their lines, by how much."""
    blocks, steps, sources = _moved(spark, base)
    none = spark.createDataFrame([], "file string, name string, start_line int, end_line int")
    at = freshness.locate_blocks(blocks.withColumn("block_id", F.col("section_id")), sources, none, follow_text=True)
    current = at.where("at is not null").select("section_id", F.col("at.start").alias("new_start"), F.when(F.col("same"), F.col("hash")).otherwise("other").alias("new_hash"))
    depth = F.when(F.col("section_id") % 5 == 0, 3).otherwise(2).alias("depth")
    refs = spark.createDataFrame([], "section_id long, file string, line int, text string, file_hash string")
    kept = freshness.reuse_sections(blocks.select("*", depth), steps, refs, current, sources, 2)
    return kept.select(F.col("section_id").alias("doc_id"), F.col("delta").cast("int").alias("delta"))
