"""Queries over statements and applications of a fixed build, one or several for each row of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql_effects import sql_effects as effects_of
from ..operators import relational, routes
from ..sources import snapshot
from ..sources.facts import HANDLER
from ..sources.tables import table
from .registry import query

#: (statement, what it reads and writes); {} is a number from the table.
STATEMENTS = [
    ("SELECT * FROM orders{} o JOIN unnest(o.items) i ON true", "SELECT orders{}"),
    ("UPDATE stock{} SET n = n - 1 FROM orders WHERE orders.id = $1", "UPDATE stock{}, SELECT orders"),
    ("INSERT INTO audit SELECT * FROM (SELECT id FROM parts{} FOR UPDATE) p ON CONFLICT (id) DO UPDATE SET n = 1", "INSERT audit, SELECT parts{}"),
    ("WITH old{} AS (DELETE FROM queue{} RETURNING *) SELECT count(*) FROM old{} WHERE extract(day FROM ts) = 1", "DELETE queue{}"),
    ("ROLLBACK", ""),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows) + ")"


@query("sql_effects", f"SELECT p_partkey, replace(e, '{{}}', CAST(p_partkey AS VARCHAR)) AS effects FROM part JOIN {_values([(i, e) for i, (_, e) in enumerate(STATEMENTS)])} v(i, e) ON i = p_partkey % {len(STATEMENTS)}")
def sql_effects(spark, base):
    """What a statement about each part reads and writes."""
    said = F.get(F.array(*(F.lit(s) for s, _ in STATEMENTS)), (F.col("p_partkey") % len(STATEMENTS)).cast("int"))
    statements = table(spark, base, "part").select("p_partkey", F.replace(said, F.lit("{}"), F.col("p_partkey").cast("string")).alias("statement"))
    found = statements.withColumn("e", effects_of(F.col("statement")))
    return found.select("p_partkey", F.array_join(F.transform("e", lambda e: e["detail"]), ", ").alias("effects"))


def _fn(name: str, arity: int = 3) -> dict:
    return {"kind": "symbol", "key": {"file": "app.ts", "name": name, "start_line": 1}, "arity": arity, "text": name}


#: (receiver, kind, call, method, path, order, handlers) of a small application.
REGISTRATIONS = [
    ("app{}.ts#app", "app", "use", None, None, 0, [{"kind": "package", "package": "express", "text": "express.json()"}]),
    ("app{}.ts#app", "app", "use", None, "/shop{}", 1, [_fn("requireUser"), {"kind": "router", "receiver_key": "shop{}.ts#shop", "text": "shop"}]),
    ("app{}.ts#app", "app", "GET", "GET", "/health{}", 2, [_fn("health", 2)]),
    ("app{}.ts#app", "app", "use", None, None, 3, [_fn("onError", 4)]),
    ("shop{}.ts#shop", "router", "use", None, "/admin", 0, [_fn("adminOnly")]),
    ("shop{}.ts#shop", "router", "POST", "POST", "/orders/:id", 1, [_fn("limit"), _fn("placeOrder", 2)]),
    ("shop{}.ts#shop", "router", "GET", "GET", "/admin/stock", 2, [_fn("stock", 2)]),
]
STITCHED = [
    ("GET", "/health{}", "app:express.json() error:onError"),
    ("POST", "/shop{}/orders/:id", "app:express.json() app:requireUser route:limit error:onError"),
    ("GET", "/shop{}/admin/stock", "app:express.json() app:requireUser router:adminOnly error:onError"),
]


def _applications(spark, base, registrations: list[tuple]):
    """Registrations of an application for each supplier."""
    rows = [(i, key, kind, "use" if call == "use" else "route", method, path, i + 1, order, handlers) for i, (key, kind, call, method, path, order, handlers) in enumerate(registrations)]
    schema = f"seq int, receiver_key string, receiver_kind string, call_kind string, method string, path string, line int, order_idx int, handlers array<{HANDLER}>"
    calls = table(spark, base, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1))).alias("seq")).join(spark.createDataFrame(rows, schema), "seq")
    own = lambda c: F.replace(c, F.lit("{}"), F.col("s_suppkey").cast("string"))
    return calls.withColumns({
        "seq": (F.col("s_suppkey") * len(rows) + F.col("seq")).cast("int"), "receiver_key": own(F.col("receiver_key")), "path": own(F.col("path")), "file": own(F.split_part("receiver_key", F.lit("#"), F.lit(1))),
        "receiver_text": F.split_part("receiver_key", F.lit("#"), F.lit(2)), "path_text": F.lit(None).cast("string"), "end_line": F.col("line"),
        "handlers": F.transform("handlers", lambda h: h.withField("receiver_key", own(h["receiver_key"]))),
    })


def _chains(found, middleware, label):
    """(s_suppkey, method, full_path, chain) of stitched routes; ``label`` names a handler."""
    entry = F.struct("order_idx", F.concat_ws(":", "phase", label).alias("entry"))
    chain = middleware.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]), " ").alias("chain"))
    supplier = F.regexp_extract("file", "([0-9]+)", 1).cast("long").alias("s_suppkey")
    return found.join(chain, "route", "left").select(supplier, "method", "full_path", F.coalesce("chain", F.lit("")).alias("chain"))


@query(
    "stitch_routes",
    f"SELECT s_suppkey, method, replace(p, '{{}}', CAST(s_suppkey AS VARCHAR)) AS full_path, chain FROM supplier, {_values(STITCHED)} v(method, p, chain)",
)
def stitch_routes(spark, base):
    """An application for each supplier."""
    found, middleware, _ = routes.stitch(_applications(spark, base, REGISTRATIONS).drop("s_suppkey"))
    return _chains(found, middleware, routes.handler_label(F.col("handler")))


#: The application of every tenth supplier after an edit: the shop is mounted elsewhere, its limit is gone and a route has come.
EDITED = [
    REGISTRATIONS[0], (*REGISTRATIONS[1][:4], "/store{}", *REGISTRATIONS[1][5:]), *REGISTRATIONS[2:5], (*REGISTRATIONS[5][:6], [_fn("placeOrder", 2)]), REGISTRATIONS[6], ("shop{}.ts#shop", "router", "GET", "GET", "/open", 3, [_fn("open", 2)]),
]
RESTITCHED = [
    STITCHED[0], ("POST", "/store{}/orders/:id", "app:express.json() app:requireUser error:onError"), ("GET", "/store{}/admin/stock", "app:express.json() app:requireUser router:adminOnly error:onError"), ("GET", "/store{}/open", "app:express.json() app:requireUser error:onError"),
]


@query(
    "restitched_routes",
    f"""SELECT s_suppkey, method, replace(p, '{{}}', CAST(s_suppkey AS VARCHAR)) AS full_path, chain FROM supplier, {_values([(0, *r) for r in STITCHED] + [(1, *r) for r in RESTITCHED])} v(edited, method, p, chain)
WHERE edited = CASE WHEN s_suppkey % 10 = 3 THEN 1 ELSE 0 END""",
)
def restitched_routes(spark, base):
    """The routes of all applications after a pass over those edited, of which alone routes are made again."""
    edited = F.col("s_suppkey") % 10 == 3
    before = _applications(spark, base, REGISTRATIONS)
    after = before.where(~edited).unionByName(_applications(spark, base, EDITED).where(edited))
    none = spark.createDataFrame([], "symbol_id string")
    old = snapshot.Snapshot({"router_calls": before.drop("s_suppkey"), "symbols": none})
    old.tables |= {n: t for n, t in snapshot.placed(routes.stitch(old["router_calls"]), none).items()}
    new = snapshot.Snapshot({"router_calls": after.drop("s_suppkey"), "symbols": none})
    touched = before.where(edited).select(F.col("file").alias("path")).distinct()
    change = snapshot.changed_routes(old, new, touched, none)
    now = {n: relational.without(old[n], change[n][1], "route").unionByName(change[n][0]) for n in ("routes", "middleware")}
    return _chains(now["routes"], now["middleware"], F.col("label"))
