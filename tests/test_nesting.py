"""Spans around points and components of graphs: by sweeps and doubling, compared with brute force."""

import random

from weftline.operators import graph, nesting

SPANS, POINTS = "id int, k string, start int, `end` int", "id int, k string, at int, until int"


def some(rng, spans, points):
    made = [(i, rng.choice("ab"), s := rng.randrange(40), s + rng.choice([-1, 0, 2, 9, 30])) for i in range(spans)]
    asked = [(i, rng.choice("abc"), a := rng.randrange(-3, 60), a + rng.choice([0, 0, 1, 6])) for i in range(points)]
    return made, asked


def test_spans_around_ranges_equal_brute_force(spark):
    spans, points = some(random.Random(3), 60, 200)
    frames = spark.createDataFrame([*spans, (900, None, 1, 2), (901, "a", None, 5)], SPANS), spark.createDataFrame([*points, (999, None, 1, 1)], POINTS)
    for first in (False, True):
        best = (lambda s: (s[2], s[0])) if first else (lambda s: (-s[2], s[3], s[0]))
        expected = {}
        for i, k, at, until in points:
            around = [s for s in spans if s[1] == k and s[2] <= at and until <= s[3]]
            if around:
                expected[i] = min(around, key=best)[0]
        got = nesting.holding(frames[1], frames[0], ["k"], first).collect()
        assert {r.id: r.span_id for r in got} == expected and len(got) == len(expected)


def test_points_inside_ranges_equal_brute_force(spark):
    ranges, points = some(random.Random(4), 50, 120)
    got = nesting.inside(spark.createDataFrame(ranges, SPANS), spark.createDataFrame([p[:3] for p in points], "id int, k string, at int"), ["k"]).collect()
    expected = {(r[0], p[0]) for r in ranges for p in points if r[1] == p[1] and r[2] <= p[2] <= r[3]}
    assert {(r.range_id, r.point_id) for r in got} == expected and len(got) == len(expected)


def test_a_hundred_thousand_nested_spans(spark):
    n = 100_000
    spans = spark.range(n).selectExpr("cast(id as int) id", "'f' k", "cast(id as int) start", f"cast({2 * n} - id as int) `end`")
    points = spark.range(2 * n).selectExpr("cast(id as int) id", "'f' k", "cast(id as int) at")
    got = nesting.holding(points, spans, ["k"])
    assert got.selectExpr(f"count_if(span_id = if(id < {n}, id, {2 * n} - id)) ok", "count(*) n").first()[:] == (2 * n - 1, 2 * n)


def strong_by_hand(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    found = {n: {m for m in reach[n] if n in reach[m]} for n in nodes}
    return {(n, min(c)) for n, c in found.items() if len(c) > 1}


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(6)
    for n, m in ((12, 14), (30, 60), (40, 45)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = graph.strong_components(spark.createDataFrame([*edges, (1, None)], "src int, dst int")).collect()
        assert {(r.node, r.component) for r in got} == strong_by_hand(edges) and len(got) == len({r.node for r in got})


def test_a_long_cycle_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rounds.append(1) or settle(df))
    names = list(range(5000))
    random.Random(1).shuffle(names)
    cycle = spark.createDataFrame(list(zip(names, names[1:] + names[:1], strict=True)), "src int, dst int")
    got = graph.strong_components(cycle).collect()
    assert len(got) == 5000 and {r.component for r in got} == {0} and len(rounds) <= 60
