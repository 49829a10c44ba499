"""Blocks found by rolling fingerprints, compared with the digest of every window."""

import hashlib
import random

from pyspark.sql import functions as F

from weftline.operators import windows


def sha(lines):
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def by_hand(lines, block, near, first, last):
    n = len(block)
    at = [s for s in range(max(first, 1), min(last, len(lines)) - n + 2) if lines[s - 1 : s - 1 + n] == block]
    return min(at, key=lambda s: (abs(s - near), s), default=None)


def test_windows_equal_a_search_by_hand(spark):
    rng = random.Random(8)
    files = {f"f{i}": [rng.choice(["", "}", "a", "bé", "return x"]) for _ in range(rng.randint(0, 40))] for i in range(12)}
    asked, expected = [], {}
    for i in range(300):
        file = f"f{rng.randrange(13)}"
        lines = files.get(file, [])
        n, at = rng.randint(1, 4), rng.randint(1, 40)
        block = lines[at - 1 : at - 1 + n] if rng.random() < 0.8 and len(lines) >= at + n else [rng.choice("ab}") for _ in range(n)]
        first, last = (1, 2**31 - 1) if rng.random() < 0.5 else sorted((rng.randint(1, 40), rng.randint(1, 45)))
        near = rng.randint(-3, 45)
        # every fourth has kept no fingerprint, every fifth a wrong digest under a right one
        digest = sha(block) if i % 5 else sha(["other"])
        asked.append((i, file, n, None if i % 4 == 0 else block, digest, near, first, last))
        expected[i] = by_hand(lines, block if i % 5 else ["other"] * n, near, first, last) if file in files else None
    rows = spark.createDataFrame(asked, "id int, file string, length int, block array<string>, hash string, near int, first int, last int")
    rows = rows.withColumn("print", windows.block_print(F.col("block"))).drop("block")
    sources = spark.createDataFrame(list(files.items()), "file string, lines array<string>")
    got = {r.id: r.start for r in windows.find_windows(rows, sources).collect()}
    assert got == {i: s for i, s in expected.items() if s is not None}


def test_fingerprints_tell_order_and_are_those_of_windows(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "a"],), (["b", "a", "c", "a"],)], "lines array<string>")
    one, two = (r[0] for r in rows.select(windows.block_print(F.col("lines"))).collect())
    assert one != two
    source = spark.createDataFrame([("f", ["x", "a", "b", "c", "a"])], "file string, lines array<string>")
    lengths = spark.createDataFrame([("f", 4), ("f", 9), ("f", 0)], "file string, length int")
    assert {r.line: r.print for r in windows.windows(source, lengths).collect()}[2] == one


def test_one_long_file_is_linear(spark):
    source = spark.range(1).select(F.lit("f").alias("file"), F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("l"), (i % 30_000).cast("string"))).alias("lines"))
    block = F.slice("lines", 20_001, 5_000)
    asked = source.select(F.lit(1).alias("id"), "file", F.lit(5_000).alias("length"), windows.block_print(block).alias("print"), windows.hash_lines(block).alias("hash"), F.lit(49_000).alias("near"), F.lit(1).alias("first"), F.lit(60_000).alias("last"))
    assert [r.start for r in windows.find_windows(asked, source).collect()] == [50_001]
