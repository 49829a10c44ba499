"""Steps whose work must not be the product of two tables: large keys, with a bound in seconds far above what a linear step takes."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import contexts, freshness, graph, relational, windows
from weftline.plans import more_queries


def test_packages_of_one_large_file(spark):
    files = spark.range(40_000).select(F.lit("t").alias("target"), F.lit("f").alias("file"), (40_000 - F.col("id")).alias("position"))
    imports = spark.range(40_000).select(F.lit("f").alias("file"), F.lit("p").alias("package_name"), F.lit("1").alias("package_version"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("imported_path"), F.array(F.lit("a")).alias("imported_names"), (F.col("id") + 7).alias("position"))
    began = time.monotonic()
    assert [(r.target, r.package, r.imported_path) for r in contexts.packages_of({"imports": imports}, files).collect()] == [("t", "p", "x0")]
    assert time.monotonic() - began < 25


def test_budget_that_pays_for_many_rows(spark):
    # 40000 rows fit, then costs of 10 and 1000 take turns until nothing fits; a group of null goes on behind its first block too
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, "g").alias("g"), F.col("id"), F.when(F.col("id") < 40_000, "").otherwise(F.repeat(F.lit("x"), (F.floor(F.col("id") / 2) % 2 * 4000).cast("int"))).alias("text"))
    limit, expected = 20_000 * 10 + 55_000, {}
    for g in (0, 1):
        left, expected[g] = limit, []
        for i in range(g, 60_000, 2):
            cost = 10 + (1000 if i >= 40_000 and i // 2 % 2 else 0)
            if cost <= left:
                left -= cost
                expected[g].append(i)
    got = relational.greedy_budget(rows, ["g"], ["id"], limit).collect()
    for g, name in ((0, "g"), (1, None)):
        assert sorted(r.id for r in got if r.g == name) == expected[g]


def test_pairs_of_one_key_are_those_of_a_join_and_spread(spark):
    left = spark.range(3000).select(F.lit("k").alias("k"), F.col("id").alias("a")).unionByName(spark.createDataFrame([("l", 1), ("m", 2), (None, 3)], "k string, a long"))
    right = spark.range(2500).select(F.lit("k").alias("k"), F.col("id").alias("b")).unionByName(spark.createDataFrame([("l", 1), ("n", 2), (None, 3)], "k string, b long"))
    got = relational.pairs_on(left, right, ["k"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("a") * 2500 + F.col("b")).alias("s")).collect()
    assert sum(r.n for r in got) == 3000 * 2500 + 1
    assert sum(r.s for r in got) == sum(range(3000 * 2500)) + 2501
    assert len(got) > 1 and max(r.n for r in got) < 0.7 * 3000 * 2500


def small_index(spark, seed):
    rng = random.Random(seed)
    symbols = [(f"s{i}", f"f{i % 2}", rng.choice(["function", "function", "class"]), a := rng.randint(1, 30), a + rng.randint(0, 8), rng.random() < 0.5) for i in range(40)]
    spans = [(t, f"f{t % 2}", a := rng.choice([1, 10, 15]), a + rng.choice([5, 20]), rng.choice([None, f"s{rng.randrange(40)}"])) for t in range(60)]
    calls = [(f"s{c}", rng.choice([None, f"s{rng.randrange(12)}"]), line := rng.randint(1, 40), f"t{c}-{line}", True, "f") for c in range(40) for _ in range(3)]
    calls = list({(c[0], c[2]): c for c in calls}.values())
    s = spark.createDataFrame(symbols, "symbol_id string, file string, kind string, start_line int, end_line int, exported boolean").withColumns({"name": F.col("symbol_id"), "signature": F.lit("")})
    c = spark.createDataFrame(calls, "caller_id string, callee_id string, call_line int, callee_text string, resolved boolean, file string")
    return {"symbols": s, "calls": c}, spark.createDataFrame(spans, "target long, file string, start int, end int, symbol_id string"), symbols, spans, calls


def test_spans_that_targets_share(spark):
    index, frame, symbols, spans, calls = small_index(spark, 5)
    owners, callers, callees = set(), [], {1: set(), 2: set(), 3: set()}
    exported = {s[0]: s[5] for s in symbols}
    for t, file, a, b, own in spans:
        held = {s[0] for s in symbols if s[2] != "class" and (s[0] == own or (s[1] == file and s[3] >= a and s[4] <= b))}
        owners |= {(t, s, s == own) for s in held}
        outer = {s[0] for s in symbols if not (s[1] == file and s[3] >= a and s[4] <= b)}
        callers += [(t, c[0], c[1], c[2]) for c in calls if c[1] in held and (c[1] == own or exported[c[1]]) and c[0] in outer]
        reached, frontier = set(held), set(held)
        for d in (1, 2, 3):
            found = [c for c in calls if c[0] in frontier and c[1] not in held and (d > 1 or a <= c[2] <= b)]
            callees[d] |= {(t, d, c[0], c[1], c[2]) for c in found}
            frontier = {c[1] for c in found if c[1]} - reached
            reached |= frontier
    got = [tuple(r) for r in contexts.owners_of(index, frame).collect()]
    assert len(got) == len(owners) and set(got) == owners
    assert sorted(tuple(r) for r in contexts.callers_of_spans(index, frame).collect()) == sorted(callers)
    for depth in (2, 3):
        rows = [(r.target, r.depth, r.caller_id, r.callee_id, r.call_line) for r in contexts.callees_of_spans(index, frame, depth).collect()]
        expected = set().union(*(callees[d] for d in range(1, depth + 1)))
        assert len(rows) == len(expected) and set(rows) == expected


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_spelled_out_a_row_at_a_time(spark, monkeypatch):
    left = spark.range(2500).select((F.col("id") % 2).alias("k"), F.col("id").alias("a")).unionByName(spark.createDataFrame([(0, None), (0, None), (2, 5)], "k long, a long"))
    right = spark.range(2300).select((F.col("id") % 2).alias("k"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(1, None), (3, 5)], "k long, b long"))
    sums = lambda rows: rows.agg(F.count("*"), F.count("a"), F.count("b"), F.sum("k"), F.sum(F.col("a") * F.col("b") + F.col("a"))).first()
    expected = sums(left.join(right, "k"))
    for most, loops in ((relational.FEW_ROWS, 1), (0, 2)):
        monkeypatch.setattr(relational, "FEW_ROWS", most)
        pairs = relational.pairs_on(left, right, ["k"])
        assert sums(pairs) == expected
        # what spells right's block out is parted from what is below it
        steps = re.findall("Generate|Coalesce", pairs._jdf.queryExecution().sparkPlan().toString())
        assert steps == ["Generate", "Coalesce", "Generate"][: loops + 1]


def test_frontiers_go_to_the_calls(spark, monkeypatch):
    index, frame, *_ = small_index(spark, 7)
    plans, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda rows: plans.append(plan(rows)) or settle(rows))
    contexts.collect_callees(index, frame.select("target", "symbol_id").where("symbol_id is not null"), 2)
    levels = [p for p in plans if p.startswith("Aggregate") and "callee_text" in p.splitlines()[0]]
    # the calls of the second level are joined where they lie, and those left out are known wherever calls are
    assert [p.count("strategy=broadcast") for p in levels] == [1, 2]


def test_callers_are_judged_before_they_are_spelled_out(spark):
    # 300 targets of one span that 400 calls lead into, half of them from inside
    symbols = [("s", "f", "function", 10, 20, True), ("in", "f", "function", 12, 13, False), ("out", "f", "function", 30, 40, False)]
    s = spark.createDataFrame(symbols, "symbol_id string, file string, kind string, start_line int, end_line int, exported boolean").withColumns({"name": F.col("symbol_id"), "signature": F.lit("")})
    calls = spark.range(400).select(F.when(F.col("id") % 2 == 0, "in").otherwise("out").alias("caller_id"), F.lit("s").alias("callee_id"), F.col("id").cast("int").alias("call_line"))
    spans = spark.range(300).select(F.col("id").alias("target"), F.lit("f").alias("file"), F.lit(10).alias("start"), F.lit(20).alias("end"), F.lit(None).cast("string").alias("symbol_id"))
    found = contexts.callers_of_spans({"symbols": s, "calls": calls}, spans)
    assert found.groupBy("caller_id").agg(F.count("*"), F.countDistinct("target"), F.countDistinct("call_line")).collect() == [("out", 300 * 200, 300, 200)]
    assert "Filter" not in plan(found).split("Generate")[0]


def test_few_and_many_spans(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    monkeypatch.setattr(relational, "FEW_ROWS", 0)
    test_spans_that_targets_share(spark)


def test_windows_are_looked_up_without_a_row_for_each_line(spark):
    lines = [f"l{i % 700}" for i in range(1400)]
    sources = spark.createDataFrame([("f", lines)], "file string, lines array<string>")
    asked = spark.range(600).select("id", F.lit("f").alias("file"), F.lit(2).alias("length"), F.array(*(F.concat(F.lit("l"), (F.col("id") + i).cast("string")) for i in (0, 1))).alias("b"), F.lit(1400).alias("near"), F.lit(1).alias("first"), F.lit(1400).alias("last"))
    # every other block has kept no fingerprint
    asked = asked.withColumns({"print": F.when(F.col("id") % 2 == 0, windows.block_print(F.col("b"))), "hash": windows.hash_lines(F.col("b"))}).drop("b")
    found = windows.find_windows(asked, sources)
    assert {r.id: r.start for r in found.collect()} == {i: 701 + i for i in range(600)}
    assert "posexplode" not in plan(found) and "Window" not in plan(found)


def test_many_symbols_of_one_name(spark):
    # the nearest of 20000 symbols for each of 20000 blocks; of symbols with one first line the longest
    symbols = spark.range(20_000).select(F.lit("f").alias("file"), F.lit("n").alias("name"), (F.floor(F.col("id") / 2) * 2).cast("int").alias("start_line"), (F.col("id") + 5).cast("int").alias("end_line"))
    blocks = spark.range(20_000).select(F.col("id").alias("block_id"), F.lit("f").alias("file"), F.lit("n").alias("symbol"), F.col("id").cast("int").alias("start"), (F.col("id") + 1).cast("int").alias("end"), F.lit("").alias("hash"))
    sources = spark.createDataFrame([("f", ["a"])], "file string, lines array<string>")
    located = freshness.locate_blocks(blocks, sources, symbols).select("block_id", "at.*")

    # of two equally near first lines the smaller
    assert located.where("`start` <> block_id - block_id % 2 or `end` <> `start` + 6").count() == 0 and located.where("`start` is not null").count() == 20_000


def test_reach_by_few_and_by_many_edges(spark, monkeypatch):
    edges = spark.range(600).select((F.col("id") % 40).alias("src"), (F.col("id") * 7 % 23).alias("dst"))
    found = []
    for most in (graph.FEW_EDGES, 0):
        monkeypatch.setattr(graph, "FEW_EDGES", most)
        found.append(sorted(map(tuple, graph.reach(edges, edges.select("src"), 3).collect())))
    assert found[0] == found[1] and len(found[0]) == 40 * 23


def test_lines_are_split_once_and_at_any_terminator(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "é😀", "", "}"]) + rng.choice(["\n", "\r\n", "\r", "\r\r\n", "\n\r\n", ""]) for _ in range(rng.randrange(6))) for _ in range(300)]
    split = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", text.split_lines("t").alias("l"))
    expected = {i: re.split("\r?\n", t) for i, t in enumerate(texts)}
    assert {r.i: r.l for r in split.collect()} == {-1: None} | {i: l[:-1] if len(l) > 1 and not l[-1] else l for i, l in expected.items()}
    assert plan(split.where("i > 0").select(F.size("l"))).count("split(") == 1


def moved_documents(spark, folder, name):
    """A query over documents whose lines moved."""
    rows = [(i, "\n".join(f"l{(i + j) % 7}" for j in range(i % 9))) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return getattr(more_queries, name)(spark, str(folder))


def test_documents_are_read_once_for_sections_to_keep(spark, tmp_path):
    kept = moved_documents(spark, tmp_path, "reused_sections")
    # what was saved is settled, so the texts as they are now are all that is read and shuffled
    assert plan(kept).count("Relation [") == 1
    assert {r.doc_id: r.delta for r in kept.collect()} == {i: (1 if i % 3 == 0 else 0) for i in range(90) if i % 9 >= 3 and i % 5 and i % 3 < 2}


def test_steps_are_looked_for_in_the_text_of_changed_blocks_alone(spark, tmp_path):
    judged = moved_documents(spark, tmp_path, "block_sections")
    assert plan(judged).count("Relation [") == 0
    rows = {r.doc_id: (r.state, r.step_fresh, r.step_line) for r in judged.collect()}
    assert rows == {i: ("fresh", True, 3) if i % 3 == 0 else ("fresh", True, 2) if i % 3 == 1 else ("changed", True, 1) for i in range(90) if i % 9 >= 3}


def test_changed_blocks_and_their_steps_equal_a_search_by_hand(spark):
    rng = random.Random(9)
    sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    near = lambda places, to: min(places, key=lambda p: (abs(p - to), p), default=None)
    files = {f"f{i}": [rng.choice("abc") for _ in range(rng.randrange(25))] for i in range(8)}
    known = [(f, "n", a := rng.randint(1, 20), a + rng.randrange(9)) for f in files for _ in range(rng.randrange(3))]
    blocks, steps, expected = [], [], {}
    for i in range(150):
        file, symbol, a, n = rng.choice([*files, "none"]), rng.choice([None, "n", "m"]), rng.randint(1, 20), rng.randint(1, 5)
        lines, old = files.get(file), [rng.choice("abc") for _ in range(n)]
        blocks.append((i, 0, file, symbol, a, a + n - 1, sha(old)))
        own = a + rng.randrange(n)
        steps.append((i, "s", file, own, own, sha(old[own - a : own - a + 1])))
        at, same = None, False
        if lines is not None and symbol:
            ends = {s: e for f, name, s, e in sorted(known) if (f, name) == (file, symbol)}
            at = (s := near(ends, a)) and (s, ends[s])
        elif lines is not None:
            now = near([p for p in range(1, len(lines) - n + 2) if lines[p - 1 : p - 1 + n] == old], a)
            at = (now, now + n - 1) if now else (a, a + n - 1) if a + n - 1 <= len(lines) else None
        same = at is not None and lines[at[0] - 1 : at[1]] == old
        step = own + at[0] - a if same else at and near([p for p in range(at[0], min(at[1], len(lines)) + 1) if lines[p - 1] == old[own - a]], own + at[0] - a)
        expected[i] = ("missing" if at is None else "fresh" if same else "changed", at, step)
    names = "section_id int, position int, file string, symbol string, start int, end int, hash string"
    sections, judged = freshness.check_block_sections(
        spark.createDataFrame(blocks, names), spark.createDataFrame(steps, "section_id int, step_id string, step_file string, step_start int, step_end int, step_hash string"),
        spark.createDataFrame(list(files.items()), "file string, lines array<string>"), spark.createDataFrame(known, "file string, name string, start_line int, end_line int"),
    )
    placed = {r.section_id: r.start if r.fresh else None for r in judged.collect()}
    assert {r.section_id: (r.state, r["at"] and tuple(r["at"]), placed[r.section_id]) for r in sections.collect()} == expected
    assert len({(e[0], e[2] is None) for e in expected.values()}) == 4
