"""Origins of values over ordinary tables: parts that stand for others, customers as classes, orders as constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import origins
from ..sources.tables import table
from .registry import query


def _walk(most: int) -> str:
    """Steps from aliases a(name, target), one at a time; e has the ends of chains."""
    return f"""w AS (SELECT name, target AS stop, 1 AS steps FROM a UNION ALL SELECT w.name, a.target, w.steps + 1 FROM w JOIN a ON a.name = w.stop WHERE w.steps < {most}),
e AS (SELECT name, stop, steps FROM w WHERE stop NOT IN (SELECT name FROM a))"""


@query(
    "value_origins",
    f"""WITH RECURSIVE a AS (SELECT p_partkey AS name, p_partkey * 7 // 10 + p_size AS target FROM part WHERE p_size % 8 > 0), {_walk(12)},
v AS (SELECT p_partkey AS name, CASE WHEN p_size % 8 = 0 THEN p_partkey ELSE e.stop END AS stop, CASE WHEN p_size % 8 = 0 THEN 0 ELSE e.steps END AS steps FROM part LEFT JOIN e ON e.name = p_partkey),
o AS (SELECT p_partkey AS stop, CASE WHEN p_partkey % 3 = 0 THEN '@s/m' ELSE 'node:m' END || p_partkey % 13 || '/x' AS specifier FROM part WHERE p_size % 8 = 0 AND p_partkey % 5 > 0)
SELECT name, steps, CASE WHEN starts_with(specifier, '@') THEN array_to_string(str_split(specifier, '/')[1:2], '/') ELSE str_split(replace(specifier, 'node:', ''), '/')[1] END AS module FROM v LEFT JOIN o USING (stop)""",
)
def value_origins(spark, base):
    """The module that each part comes from, over at most twelve others."""
    parts = table(spark, base, "part").select(F.col("p_partkey").alias("name"), "p_size")
    aliases = parts.where("p_size % 8 > 0").select("name", F.expr("name * 7 div 10 + p_size").alias("target"))
    specifier = F.concat(F.when(F.col("name") % 3 == 0, "@s/m").otherwise("node:m"), (F.col("name") % 13).cast("string"), F.lit("/x"))
    outside = parts.where("p_size % 8 = 0 and name % 5 > 0").select("name", specifier.alias("specifier"))
    return origins.value_origins(parts, aliases, outside).select("name", "steps", origins.module_of(F.col("origin")).alias("module"))


@query(
    "class_statuses",
    f"""WITH RECURSIVE c AS (SELECT c_custkey AS name, CASE WHEN c_custkey % 11 > 0 THEN c_custkey // 2 + c_nationkey END AS base, c_nationkey % 4 = 0 AS ctor, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 700 END AS status FROM customer),
a AS (SELECT name, base AS target FROM c WHERE NOT ctor AND base IS NOT NULL), {_walk(5)},
d AS (SELECT c.name, CASE WHEN ctor THEN c.name ELSE e.stop END AS stop FROM c LEFT JOIN e USING (name))
SELECT d.name, s.status FROM d LEFT JOIN c s ON s.name = d.stop AND s.ctor AND s.status BETWEEN 100 AND 599""",
)
def class_statuses(spark, base):
    """Customers as classes: the status of their own or of the first base with a constructor, at most five up."""
    key = F.col("c_custkey")
    classes = table(spark, base, "customer").select(
        key.alias("name"), F.when(key % 11 > 0, F.expr("c_custkey div 2 + c_nationkey")).alias("base"), (F.col("c_nationkey") % 4 == 0).alias("has_constructor"), F.when(key % 3 > 0, key % 700).alias("status")
    )
    return origins.class_statuses(classes)


@query(
    "constant_texts",
    f"""WITH RECURSIVE k AS (SELECT o_orderkey AS name, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS text, o_orderkey // 2 AS target FROM orders),
a AS (SELECT name, target FROM k WHERE text IS NULL), {_walk(3)}
SELECT k.name, coalesce(k.text, t.text) AS text FROM k LEFT JOIN e USING (name) LEFT JOIN k t ON t.name = e.stop""",
)
def constant_texts(spark, base):
    """Orders as constants: the literal that each stands for, through at most three others."""
    own = F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority"))
    return origins.constant_texts(table(spark, base, "orders").select(F.col("o_orderkey").alias("name"), own.alias("text"), F.expr("o_orderkey div 2").alias("target")))
