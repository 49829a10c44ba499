"""Reachability, shortest paths, strongly connected components and dependency order over edge tables."""

from __future__ import annotations

import heapq
import itertools
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few keys each, as edges of one level that ``reach`` asks for, that are broadcast at most.
FEW_EDGES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors reach; one of its own only where a local session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage through the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(rows: DataFrame, most: int | None = None) -> bool:
    """Whether ``rows``, which should be cheap to read, are at most ``most`` (FEW_EDGES unless given)."""
    most = FEW_EDGES if most is None else most
    return rows.limit(most + 1).count() <= most


def sent(rows: DataFrame) -> DataFrame:
    """``rows`` settled, and broadcast to what they are joined with where they are few."""
    rows = settle(rows)
    return F.broadcast(rows) if few(rows) else rows


def callees(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, depth, src, dst, *rest): every edge on a path of at most ``depth`` edges from a root, once for each path.

    A path stops where it would enter a node for the second time, after putting
    out the edge that closes the cycle. Edges to null (calls that lead nowhere
    known) are put out and not followed. ``edges`` has src, dst and any further
    columns, ``roots`` one column.
    """
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    step = roots.toDF("root").distinct().select("root", F.col("root").alias("src"), F.array("root").alias("_seen"))
    out = None
    for d in range(1, depth + 1):
        reached = step.join(edges, "src")
        found = reached.select("root", F.lit(d).alias("depth"), "src", "dst", *rest)
        out = found if out is None else out.unionByName(found)
        onward = reached.where(F.col("dst").isNotNull() & ~F.array_contains("_seen", F.col("dst")))
        step = onward.select("root", F.col("dst").alias("src"), F.concat("_seen", F.array("dst")).alias("_seen"))
    return out


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, depth): nodes other than by the empty path within ``depth`` edges of each root, at their least depth.

    A frontier that drops what a root has seen already grows with the number of
    nodes, not of paths. A root reached again over a cycle counts with that depth.
    """
    edges = settle(edges.select("src", "dst").where("dst is not null").distinct())
    frontier = roots.toDF("root").distinct().select("root", F.col("root").alias("src"))
    found = None
    for d in range(1, depth + 1):
        steps = edges
        if d > 1:
            # where few edges go on, they go to the roots, whose repeats then meet in one task before anything is shuffled
            onward = settle(edges.join(frontier.select("src").distinct(), "src", "left_semi"))
            steps, frontier = (F.broadcast(onward), frontier.repartition("root")) if few(onward) else (onward, frontier)
        nodes = frontier.join(steps, "src").select("root", F.col("dst").alias("node")).distinct()
        if found is not None:
            nodes = nodes.join(found.select("root", "node"), ["root", "node"], "left_anti")
        nodes = settle(nodes.withColumn("depth", F.lit(d)))
        found = nodes if found is None else found.unionByName(nodes)
        frontier = nodes.select("root", F.col("node").alias("src"))
    return found


def spread(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node): ``starts`` (node) and all that edges (src, dst) lead to from there."""
    found = frontier = settle(starts.select("node").where("node is not null").distinct())
    while not frontier.isEmpty():
        step = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        frontier = settle(step.join(found, "node", "left_anti"))
        found = found.unionByName(frontier)
    return found


def closest_reaching(edges: DataFrame, starts: DataFrame, stops: DataFrame, hops: int) -> DataFrame:
    """(start, node, hops): nodes that reach a start against the edges within ``hops``, at their least distance.

    The search does not go on from a node in ``stops`` (one column). The start counts, at distance 0.
    """
    edges = edges.select("src", "dst").where("dst is not null and src is not null").distinct()
    stops = stops.toDF("node").distinct()
    found = settle(starts.toDF("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops")))
    frontier = found
    for d in range(1, hops + 1):
        going = frontier.join(stops, "node", "left_anti")
        nodes = going.select("start", F.col("node").alias("dst")).join(edges, "dst").select("start", F.col("src").alias("node")).distinct()
        nodes = settle(nodes.join(found.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(d)))
        if nodes.isEmpty():
            break
        found = found.unionByName(nodes)
        frontier = nodes
    return found


def shortest_paths(edges: DataFrame, roots: DataFrame, most: int | None = None, rank: Column | None = None) -> DataFrame:
    """(root, node, path): a shortest path (of at most ``most`` edges, if given) to each node, of these the first by its edges' ``rank``.

    ``rank`` is an expression over an edge's columns (dst unless given); paths of
    equal length compare edge by edge. Only the best path to each node goes on,
    which loses nothing: every beginning of a best path is itself best.
    """
    edges = edges.where("dst is not null").select("src", "dst", (F.col("dst") if rank is None else rank).alias("_rank"))
    edges = edges.groupBy("src", "dst").agg(F.min("_rank").alias("_rank"))
    frontier = roots.toDF("root").distinct().select("root", F.col("root").alias("src"), F.array("root").alias("path"), F.array().cast(f"array<{edges.schema['_rank'].dataType.simpleString()}>").alias("_ranks"))
    found = None
    for _ in itertools.count() if most is None else range(most):
        steps = frontier.join(edges, "src").select("root", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("_ranks", F.array("_rank")).alias("_ranks"))
        steps = steps.where(F.col("node") != F.col("root"))
        if found is not None:
            steps = steps.join(found.select("root", "node"), ["root", "node"], "left_anti")
        best = steps.groupBy("root", "node").agg(F.min_by(F.struct("path", "_ranks"), "_ranks").alias("_b"))
        best = settle(best.select("root", "node", "_b.path", "_b._ranks"))
        found = best if found is None else found.unionByName(best)
        if best.isEmpty():
            break
        frontier = best.select("root", F.col("node").alias("src"), "path", "_ranks")
    return found.drop("_ranks")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles with the least node they reach both ways; nodes on no cycle are left out.

    In each round every node takes the least node that reaches it, and then,
    along edges between nodes of the same one, the least that it reaches. Where
    the two are equal they name a component, of as many pivots at once as there
    are different least nodes; all else goes on within nodes of equal pairs,
    which components never leave.
    """
    live = settle(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    left, done = live.count(), None
    while left:
        # nodes that nothing leads to or from lie on no cycle
        inner = live.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        live = settle(inner.select("src", "dst"))
        had, left = left, live.count()
        if 2 * left < had or not left:
            continue
        into = _least(live)
        own = settle(_within(live, into))
        out_of = _least(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        met = settle(into.join(out_of.toDF("node", "least"), "node").where("colour = least").select("node", F.col("colour").alias("component")))
        done = met if done is None else done.unionByName(met)
        rest = _within(own, out_of).join(met.select(F.col("node").alias("src")), "src", "left_anti").join(met.select(F.col("node").alias("dst")), "dst", "left_anti")
        live = settle(rest.select("src", "dst"))
        left = live.count()
    if done is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = done.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1")
    return done.join(sizes.select("component"), "component", "left_semi").select("node", "component")


def _within(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """Edges between nodes of one colour."""
    # not an equality, by which Spark might join all nodes of a colour with each other first
    same = (F.col("_cs") <= F.col("_cd")) & (F.col("_cs") >= F.col("_cd"))
    return edges.join(colour.toDF("src", "_cs"), "src").join(colour.toDF("dst", "_cd"), "dst").where(same).select("src", "dst")


def _least(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches each node, itself included.

    What reaches a node's colour reaches the node, so each round takes the
    colour's colour too: ways get longer in proportion, not by an edge a round.
    """
    colour = settle(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    while True:
        passed = edges.join(colour.toDF("src", "colour"), "src").select(F.col("dst").alias("node"), "colour", F.lit(None).cast(colour.schema["colour"].dataType).alias("_old"))
        near = colour.select("node", "colour", F.col("colour").alias("_old")).unionByName(passed).groupBy("node").agg(F.min("colour").alias("colour"), F.max("_old").alias("_old"))
        jumped = near.join(near.select(F.col("node").alias("colour"), F.col("colour").alias("_far")), "colour")
        new = settle(jumped.select("node", F.least("colour", "_far").alias("colour"), "_old"))
        colour = new.select("node", "colour")
        if new.where("colour <> _old").isEmpty():
            return colour


def dependency_order(functions: DataFrame, edges: DataFrame, group: str = "file") -> DataFrame:
    """(group, position, name, start, cycle): functions so that each comes after all it calls.

    ``functions`` has group, name, start; ``edges`` group, src and dst (starts).
    Of the functions that are ready the first in the source comes next; functions
    that call each other come together, in source order, and ``cycle`` names them.
    The choice is sequential, so each group (a file) is ordered by one task.
    """
    calls = edges.groupBy(group).agg(F.collect_set(F.struct("src", "dst")).alias("calls"))
    gathered = functions.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("functions")).join(calls, group, "left")
    kind = dict(functions.dtypes)[group]

    def order(batches):
        for batch in batches:
            rows = []
            for key, listed, links in zip(batch[group], batch["functions"], batch["calls"], strict=True):
                names = {f["start"]: f["name"] for f in listed}
                pairs = [(c["src"], c["dst"]) for c in (links if links is not None else [])]
                rows += [(key, at, names[s], s, cycle) for at, (s, cycle) in enumerate(_ordered(names, pairs))]
            yield pd.DataFrame(rows, columns=[group, "position", "name", "start", "cycle"])

    return gathered.select(group, "functions", "calls").mapInPandas(order, f"{group} {kind}, position int, name string, start int, cycle string")


def _ordered(names: dict[int, str], pairs: list[tuple[int, int]]) -> list[tuple[int, str | None]]:
    """Starts in order, each with the note of its cycle: strong components first, then a heap of those that are ready."""
    needs: dict[int, set[int]] = {s: set() for s in names}
    for a, b in pairs:
        if a in needs and b in needs and a != b:
            needs[a].add(b)
    component = _strong(needs)
    members: dict[int, list[int]] = {}
    for s in sorted(names):
        members.setdefault(component[s], []).append(s)
    waits = {c: {component[n] for s in own for n in needs[s]} - {c} for c, own in members.items()}
    users: dict[int, list[int]] = {c: [] for c in members}
    for c, others in waits.items():
        for o in others:
            users[o].append(c)
    open_ = {c: len(others) for c, others in waits.items()}
    ready = [(own[0], c) for c, own in members.items() if not open_[c]]
    heapq.heapify(ready)
    out: list[tuple[int, str | None]] = []
    while ready:
        _, c = heapq.heappop(ready)
        listed = [names[m] for m in members[c]]
        note = f"{', '.join(listed[:-1])} and {listed[-1]} call each other; walked in source order" if len(listed) > 1 else None
        out += [(m, note) for m in members[c]]
        for user in users[c]:
            open_[user] -= 1
            if not open_[user]:
                heapq.heappush(ready, (members[user][0], user))
    return out


def _strong(needs: dict[int, set[int]]) -> dict[int, int]:
    """The strong component of each node: two depth-first passes, the second against the edges in falling order of completion."""
    against: dict[int, list[int]] = {s: [] for s in needs}
    for s, others in needs.items():
        for o in others:
            against[o].append(s)
    finished: list[int] = []
    seen: set[int] = set()
    for root in needs:
        if root in seen:
            continue
        seen.add(root)
        todo = [(root, iter(needs[root]))]
        while todo:
            node, rest = todo[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                finished.append(node)
                todo.pop()
            else:
                seen.add(following)
                todo.append((following, iter(needs[following])))
    component: dict[int, int] = {}
    for root in reversed(finished):
        reached = [root]
        while reached:
            node = reached.pop()
            if node not in component:
                component[node] = root
                reached += against[node]
    return component
