import random

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators import origins
from weftline.plans import origin_queries  # noqa: F401
from weftline.plans.registry import oracle_sql, queries

ALIASES = "name string, target string"


def walked(aliases, most):
    """Each chain a step at a time."""
    to = {}
    for name, target in aliases:
        if name is not None and target is not None:
            to[name] = min(target, to.get(name, target))
    out = {}
    for name in to:
        at, steps = name, 0
        while at in to and steps <= most:
            at, steps = to[at], steps + 1
        out[name] = (at, steps) if at not in to and steps <= most else (None, None)
    return out


@pytest.mark.parametrize("most", [1, 3, 5, 12])
def test_chain_ends_equal_a_walk(spark, most):
    rng = random.Random(most)
    line = [(f"l{i:02}", f"l{i + 1:02}") for i in range(20)]
    loop = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("self", "self")]
    rest = [(f"r{rng.randrange(150)}", f"r{rng.randrange(150)}") for _ in range(120)]
    aliases = line + loop + rest + rest[:5] + [(None, "a"), ("n", None), (None, None)]
    got = {r.name: (r.end, r.steps) for r in origins.chain_ends(spark.createDataFrame(aliases, ALIASES), most).collect()}
    assert got == walked(aliases, most)
    assert got["l10"] == (("l20", 10) if most == 12 else (None, None)) and got["a"] == (None, None)


def test_chain_ends_of_nothing(spark):
    assert origins.chain_ends(spark.createDataFrame([], ALIASES), 12).collect() == []


def test_origins_of_values(spark):
    """A pool made from an imported class, through a re-export; code of one's own; a name that nobody knows."""
    values = spark.createDataFrame([("client",), ("pool",), ("Pool",), ("own",), ("nobody",), (None,)], "name string")
    aliases = spark.createDataFrame([("client", "pool"), ("pool", "db.Pool"), ("db.Pool", "Pool"), ("own", "helper")], ALIASES)
    outside = spark.createDataFrame([("Pool", "pg"), ("Pool", "pg")], "name string, specifier string")
    got = {r.name: (r.origin, r.steps) for r in origins.value_origins(values, aliases, outside).collect()}
    assert got["client"] == ("pg", 3) and got["Pool"] == ("pg", 0) and got["own"] == (None, 1) and got["nobody"] == (None, 0)
    assert got["pool"] == ("pg", 2)


def test_module_of(spark):
    names = {"node:events": "events", "@prisma/client/runtime": "@prisma/client", "axios/lib": "axios", "pg": "pg"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", origins.module_of(F.col("n")).alias("m")).collect()
    assert {r.n: r.m for r in rows} == names


def test_class_statuses(spark):
    rows = [
        ("Http", "Error", True, None), ("NotFound", "Http", True, 404), ("NoUser", "NotFound", False, None), ("Odd", "Http", True, 42), ("Plain", "Error", False, None), ("Plain", "Error", False, None),
        ("c0", "NotFound", False, None), *((f"c{i}", f"c{i - 1}", False, None) for i in range(1, 7)), ("Ring", "Ring", False, 500), (None, "Http", True, 400),
    ]
    got = {r.name: r.status for r in origins.class_statuses(spark.createDataFrame(rows, "name string, base string, has_constructor boolean, status int")).collect()}
    assert got == {"Http": None, "NotFound": 404, "NoUser": 404, "Odd": None, "Plain": None, "Ring": None, **{f"c{i}": 404 if i < 5 else None for i in range(7)}}


def test_constant_texts(spark):
    rows = [("A", "/api", None), ("B", None, "A"), ("C", None, "B"), ("D", None, "C"), ("E", None, "D"), ("X", None, "Y"), ("Y", None, "X"), ("Z", "z", "A"), (None, "n", None), ("empty", "", "A")]
    got = {r.name: r.text for r in origins.constant_texts(spark.createDataFrame(rows, "name string, text string, target string")).collect()}
    assert got == {"A": "/api", "B": "/api", "C": "/api", "D": "/api", "E": None, "X": None, "Y": None, "Z": "z", "empty": ""}


@pytest.mark.parametrize("name", ["value_origins", "class_statuses", "constant_texts"])
def test_rows_equal_sql(spark, name):
    base = "/root/testdata/sf0.001"
    got = queries()[name](spark, base)
    con = duckdb.connect()
    for t in ("part", "customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key) and sorted(columns) == sorted(got.columns)
    assert len({r[1:] for r in want}) > 2
