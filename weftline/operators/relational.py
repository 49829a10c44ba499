"""Interval, nearest-match, first-of-key and budget operators over DataFrames.

Each takes DataFrames and column names, so one implementation serves code facts
and ordinary tables. Joins carry an equality wherever the data have one, so that
Spark can hash or sort by it and keeps ranges as residual conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import block_cost
from .graph import few, settle

#: Rows of a few short columns that ``pairs_on`` broadcasts at most, in blocks.
FEW_ROWS = 500_000


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by a total order."""
    numbered = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_nth = 1").drop("_nth")


def first_value(rows: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """``values`` of the row of least ``order`` in each key; combines before it shuffles, unlike a window."""
    best = F.min_by(F.struct(*values), order).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether closed intervals share a point."""
    return (a_start <= b_end) & (a_end >= b_start)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (a_end >= b_end)


def strictly_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return contains(a_start, a_end, b_start, b_end) & ((a_start < b_start) | (a_end > b_end))


def buckets_of(start: Column, end: Column, width: int) -> Column:
    """The numbers of the width-wide cells that a closed interval touches."""
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width: int) -> DataFrame:
    """Pairs of rows (l_id, r_id) with equal ``on`` whose [start, end] overlap.

    ``left`` and ``right`` have id, start, end and the ``on`` columns. Intervals are
    dealt to cells of ``width``; a pair is put out in the cell of its later start
    alone, so that no duplicates arise and nothing needs to be made distinct.
    """
    cells = lambda df, p: df.select(*on, F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.explode(buckets_of(F.col("start"), F.col("end"), width)).alias("_cell"))
    pairs = cells(left, "l").join(cells(right, "r"), [*on, "_cell"])
    later = F.floor(F.greatest("l_start", "r_start") / width).cast("long")
    return pairs.where(overlaps(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")) & (later == F.col("_cell"))).select(*on, "l_id", "r_id")


def outermost(spans: DataFrame, on: list[str]) -> DataFrame:
    """The spans (id, start, end, *on) that no other span with the same ``on`` strictly contains.

    With the spans of a key ordered by start and falling end, one is contained if
    an earlier one ends at or after it, equal intervals apart: a running maximum
    replaces the self-join.
    """
    rank = F.dense_rank().over(W.partitionBy(*on).orderBy("start", F.desc("end")))
    ranked = spans.withColumn("_rank", rank)
    before = W.partitionBy(*on).orderBy("_rank").rangeBetween(W.unboundedPreceding, -1)
    reach = F.max("end").over(before)
    return ranked.withColumn("_reach", reach).where("_reach is null or _reach < `end`").drop("_rank", "_reach")


def merge_ranges(ranges: DataFrame, on: list[str]) -> DataFrame:
    """Disjoint unions (on, start, end) of closed integer ranges; overlapping and adjacent ones join."""
    w = W.partitionBy(*on).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*on, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def nearest_match(queries: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
    """For each query (id, near, *on) the line among ``lines`` (line, *on) nearest to ``near``; of two the smaller.

    Where queries have first and last, the line must lie within them.
    """
    # one sweep up and one down over both, in place of a join of all lines of a key with all its queries
    kind = queries.schema["id"].dataType
    bounded = {"first", "last"} <= set(queries.columns)
    far = F.lit(None).cast("long")
    first, last = (F.col("first").cast("long"), F.col("last").cast("long")) if bounded else (far, far)
    near = F.col("near").cast("long")
    # from a place within the bounds the nearest on either side is the nearest within them on that side
    at = F.greatest(F.least(near, last), first) if bounded else near
    asked = queries.select(*on, "id", near.alias("_near"), at.alias("_at"), first.alias("_first"), last.alias("_last"), far.alias("line"))
    there = lines.select(*on, F.lit(None).cast(kind).alias("id"), far.alias("_near"), F.col("line").cast("long").alias("_at"), far.alias("_first"), far.alias("_last"), F.col("line").cast("long").alias("line"))
    sweep = lambda order: W.partitionBy(*on).orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = asked.withColumn("_asks", F.lit(True)).unionByName(there.withColumn("_asks", F.lit(False)))
    both = both.withColumn("_low", F.max("line").over(sweep(F.col("_at")))).withColumn("_high", F.min("line").over(sweep(F.col("_at").desc())))
    low, high = (F.when(F.col(c).between(F.coalesce("_first", c), F.coalesce("_last", c)), F.col(c)) for c in ("_low", "_high"))
    both = both.where("_asks").select("id", "_near", low.alias("_low"), high.alias("_high"))
    below = F.col("_high").isNull() | (F.abs(F.col("_near") - F.col("_low")) <= F.abs(F.col("_high") - F.col("_near")))
    found = both.select("id", "_near", F.when(F.col("_low").isNotNull() & below, F.col("_low")).otherwise(F.col("_high")).alias("line")).where("line is not null")
    return found.groupBy("id").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("_near")), F.col("line"))).alias("line"))


def pairs_on(left: DataFrame, right: DataFrame, on: list[str], block: int = 1000) -> DataFrame:
    """(on, left's other columns, right's other columns): the inner join, for keys with very many rows on both sides.

    Rows of a key go in blocks of ``block``. Where right has at most FEW_ROWS, its
    blocks go to left's rows, dealt evenly; else only pairs of blocks are joined
    and shuffled. Pairs are spelled out after that, so that what is moved is a
    small part of the result and no task has more of it than its share. A task
    holds right's blocks, each with a left row, never the pairs themselves. Right
    is read to be counted first.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rest(rows: DataFrame) -> list[str]:
        return [c for c in rows.columns if c not in on]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*on).orderBy(*rest(rows)))
        return rows.withColumn(f"{name}_at", F.floor((nth - 1) / block)).groupBy(*on, f"{name}_at").agg(F.collect_list(F.struct(*rest(rows))).alias(name))

    # a number given: adaptive execution would merge partitions that are small before the pairs are spelled out
    if few(right, FEW_ROWS):
        singly = left.repartition(parts).join(F.broadcast(blocks(right, "_r")), on)
    else:
        both = blocks(left, "_l").join(blocks(right, "_r"), on).repartition(parts, *on, "_l_at", "_r_at")
        singly = both.select(*on, F.inline("_l"), "_r")
    # coalescing to as many moves nothing but ends the generated loop: one loop in the other would gather all pairs of a key before any is passed on
    return singly.coalesce(parts).select(*on, *rest(left), F.inline("_r"))


def relocatable(text: Column) -> Column:
    """Lines without a letter, "_" or "$" are too ambiguous to follow."""
    return text.rlike("[A-Za-z_$]")


def greedy_budget(rows: DataFrame, group: list[str], order: list[str], limit: int, text: str = "text", key: str = "id", block: int = 2000) -> DataFrame:
    """(group, key, cost) of the rows taken: in order, each whose cost still fits; one that does not is skipped and costs nothing.

    What fits depends on all earlier choices, so candidates are folded one by
    one, but never more than ``block`` of a group at once: those before all
    others by order that what is left could pay for. Groups that filled their
    block go on behind it with what is left: all is taken up to the first that
    does not fit, by running sums over ranges of a group, then a block is folded
    again. Only keys and costs, not texts, are moved; the row limit applies before the shuffle.
    """
    kind = dict(rows.dtypes)[key]
    costed = rows.select(F.struct(*group).alias("_group"), F.struct(*order).alias("_at"), F.col(key).alias("_key"), block_cost(F.col(text)).cast("long").alias("_cost"))
    candidates, out, kept = costed.withColumn("_left", F.lit(limit).cast("long")), None, False

    def take(state: Column, row: Column) -> Column:
        fits = row["_cost"] <= state["left"]
        taken = F.concat(state["taken"], F.array(F.struct(row["_key"].alias("key"), row["_cost"].alias("cost"))))
        return F.struct(F.when(fits, state["left"] - row["_cost"]).otherwise(state["left"]).alias("left"), F.when(fits, taken).otherwise(state["taken"]).alias("taken"))

    while True:
        nth = F.row_number().over(W.partitionBy("_group").orderBy("_at", "_key"))
        first = candidates.where("_cost <= _left").withColumn("_nth", nth).where(F.col("_nth") <= block)
        gathered = first.groupBy("_group").agg(F.first("_left").alias("_left"), F.array_sort(F.collect_list(F.struct("_at", "_key", "_cost"))).alias("_rows"))
        start = F.struct(F.col("_left").alias("left"), F.array().cast(f"array<struct<key:{kind},cost:bigint>>").alias("taken"))
        folded = settle(gathered.select("_group", F.aggregate("_rows", start, take).alias("_s"), F.element_at("_rows", -1).alias("_last"), (F.size("_rows") == block).alias("_full")))
        taken = folded.select("_group", F.explode("_s.taken").alias("_t")).select("_group.*", F.col("_t.key").alias(key), F.col("_t.cost").alias("cost"))
        out = taken if out is None else out.unionByName(taken)
        on = folded.where("_full").select("_group", F.col("_s.left").alias("_left"), F.struct("_last._at", "_last._key").alias("_done"))
        if on.isEmpty():
            return out
        if not kept:
            costed, kept = settle(costed), True
        behind = costed.join(on, "_group").where((F.struct("_at", "_key") > F.col("_done")) & (F.col("_cost") <= F.col("_left"))).drop("_done")
        summed = running_sum(behind, ["_group"], ["_at", "_key"], "_cost", "_sum")
        fits = summed.where("_sum <= _left")
        out = out.unionByName(fits.select("_group.*", F.col("_key").alias(key), F.col("_cost").alias("cost")))
        spent = fits.groupBy("_group").agg(F.max("_sum").alias("_spent"))
        candidates = summed.where("_sum > _left").join(spent, "_group", "left").withColumn("_left", F.col("_left") - F.coalesce("_spent", F.lit(0))).drop("_sum", "_spent")


def running_sum(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row of its group (of columns without nulls) in a total order; ranges of a group are summed apart, so no task sees all of it."""
    placed = settle(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*group, "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    so_far = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.withColumn(name, F.sum(value).over(so_far)).join(totals, [*group, "_range"])
    return settle(summed.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before"))


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, changed or removed between two versions of (key, digest); unchanged keys are left out."""
    both = old.select(key, F.col(digest).alias("_old"), F.lit(True).alias("_had")).join(new.select(key, F.col(digest).alias("_new"), F.lit(True).alias("_has")), key, "full_outer")
    change = F.when(F.col("_had").isNull(), "added").when(F.col("_has").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def dependents(edges: DataFrame, touched: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct ``source`` of edges into ``touched`` (one column) that are not touched themselves."""
    hit = edges.join(touched.toDF(target), target, "left_semi").select(source).distinct()
    return hit.join(touched.toDF(source), source, "left_anti")


def within(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is among ``keys`` (one column), once each; its columns stay in order."""
    return rows.join(keys.toDF(column), column, "left_semi").select(rows.columns)


def last_of_sources(sources: list[DataFrame], key: str, value: str, order: str) -> DataFrame:
    """(key, value, first_source): a union of tables in which a key keeps its first place and its last value; ``order`` is within a table."""
    placed = [s.select(key, F.lit(i + 1).alias("_source"), F.col(order).alias("_order"), value) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, placed)
    return every.groupBy(key).agg(F.max_by(value, F.struct("_source", "_order")).alias(value), F.min("_source").alias("first_source"))


def without(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is not among ``gone`` (one column); its columns stay in order."""
    return rows.join(gone.toDF(column), column, "left_anti").select(rows.columns)


def cascade(gone: DataFrame, tables: dict[str, DataFrame], steps: list[tuple[str, str, str | None]]) -> dict[str, DataFrame]:
    """``tables`` without what hangs on ``gone`` (one column of keys).

    Each step is (table, column that refers to the step before it, own key): rows
    that refer to what went go too, and their keys are what went for the next step.
    """
    left = dict(tables)
    for name, parent, key in steps:
        rows = tables[name]
        left[name] = without(rows, gone, parent)
        if key:
            gone = rows.join(gone.toDF(parent), parent, "left_semi").select(key).distinct()
    return left


def grouped_names(rows: DataFrame, key: str, names: str) -> DataFrame:
    """(key, names): sorted distinct elements of an array column by key; keys with only empty arrays keep an empty one."""
    flat = rows.select(key, F.explode_outer(names).alias("_name"))
    return flat.groupBy(key).agg(F.sort_array(F.collect_set("_name")).alias(names))


def exists_flag(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with whether ``others`` has the key."""
    found = others.select(key).distinct().withColumn(flag, F.lit(True))
    return rows.join(found, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """``old`` with ``new`` written over it by key; a row whose value stays the same keeps its time."""
    o = old.select(*keys, F.col(value).alias("_ov"), F.col(time).alias("_ot"), F.lit(True).alias("_o"))
    n = new.select(*keys, F.col(value).alias("_nv"), F.col(time).alias("_nt"), F.lit(True).alias("_n"))
    both = o.join(n, keys, "full_outer")
    kept = F.col("_n").isNull() | (F.col("_o").isNotNull() & F.col("_ov").eqNullSafe(F.col("_nv")))
    return both.select(*keys, F.when(F.col("_n").isNull(), F.col("_ov")).otherwise(F.col("_nv")).alias(value), F.when(kept, F.col("_ot")).otherwise(F.col("_nt")).alias(time))


def number_all(rows: DataFrame, order: list[str], start: int = 0, name: str = "id") -> DataFrame:
    """Numbers from ``start`` + 1 over all rows in a total order: a sort by ranges, then an offset for each range; no task sees all rows."""
    place = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    placed = settle(placed.withColumn("_range", F.shiftright("_place", 33)))
    # one number for each range comes to the driver
    sizes = dict(map(tuple, placed.groupBy("_range").count().collect()))
    before, total = {}, start
    for key in sorted(sizes):
        before[key], total = total, total + sizes[key]
    offset = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[F.col("_range")] if before else F.lit(start)
    nth = F.col("_place") - F.shiftleft(F.col("_range"), 33)
    return placed.withColumn(name, (offset + nth + 1).cast("long")).drop("_place", "_range")


def number_rows(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "position") -> DataFrame:
    """Positions from 0 within each key."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
