"""Where values come from: chains of aliases, and facts inherited or folded along them.

Imports, re-exports and declarations give edges from a name to the one it stands
for, at most one for each name. Chains are followed by doubling: each round joins
the ways found so far with themselves, so a bound of twelve needs four rounds
whatever the number of names, and the joins have an equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settle
from .relational import first_value


def chain_ends(aliases: DataFrame, most: int) -> DataFrame:
    """(name, end, steps): for each name that is an alias where its chain stops, after how many steps.

    ``aliases`` has name and target; of several targets of a name the least
    counts, null names and targets count for nothing. A chain ends at the first
    name that is no alias. ``end`` and ``steps`` are null where that takes more
    than ``most`` steps, as on every cycle.
    """
    one = aliases.where("name is not null and target is not null").groupBy("name").agg(F.min("target").alias("end"))
    # a way is open as long as it stops at an alias; open ways are all of the same length, 1, 2, 4, ...
    ways = one.select("name", "end", F.lit(1).alias("steps"))
    names = one.select(F.col("name").alias("end"), F.lit(True).alias("_open"))
    ways = settle(ways.join(names, "end", "left").select("name", "end", "steps", F.coalesce("_open", F.lit(False)).alias("open")))
    length = 1
    while length < most:
        on = ways.select(F.col("name").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        going = ways.where("open").join(on, "end").select("name", F.col("_end").alias("end"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"))
        ways = settle(ways.where("not open").unionByName(going))
        length *= 2
        if ways.where("open").isEmpty():
            break
    fits = ~F.col("open") & (F.col("steps") <= most)
    return ways.select("name", F.when(fits, F.col("end")).alias("end"), F.when(fits, F.col("steps")).alias("steps"))


def value_origins(values: DataFrame, aliases: DataFrame, origins: DataFrame, most: int = 12) -> DataFrame:
    """(name, origin, steps): the module that each name's value was made from.

    ``values`` has name, ``aliases`` name and target (a declaration and what
    initialises it, an import and what is exported there), ``origins`` name and
    specifier: names that come from outside the code. Origin is the specifier at
    the end of a name's chain, null where that is the code's own, unknown or more
    than ``most`` steps away; steps is null for those chains without an end.
    """
    ends = values.select("name").distinct().join(chain_ends(aliases, most), "name", "left")
    chained = aliases.where("name is not null and target is not null").select("name", F.lit(True).alias("_alias")).distinct()
    ends = ends.join(chained, "name", "left").select("name", F.when(F.col("_alias"), F.col("end")).otherwise(F.col("name")).alias("end"), F.when(F.col("_alias"), F.col("steps")).otherwise(0).alias("steps"))
    outside = origins.groupBy(F.col("name").alias("end")).agg(F.min("specifier").alias("origin"))
    return ends.join(outside, "end", "left").select("name", "origin", "steps")


def module_of(specifier: Column) -> Column:
    """The package of an import specifier: without ``node:`` and what lies below the package."""
    bare = F.regexp_replace(specifier, "^node:", "")
    return F.when(bare.startswith("@"), F.substring_index(bare, "/", 2)).otherwise(F.substring_index(bare, "/", 1))


def class_statuses(classes: DataFrame, most: int = 5) -> DataFrame:
    """(name, status): the HTTP status that each class hands to its base.

    ``classes`` has name, base, has_constructor and status (the literal that its
    constructor passes on, null if none). A class without a constructor has its
    base's status, over at most ``most`` bases. Statuses outside 100-599 count
    for nothing. Of several rows of a name the one with the least base counts.
    """
    order = F.struct(F.col("base").isNull().alias("none"), "base", "has_constructor", "status")
    own = first_value(classes.where("name is not null"), ["name"], order, ["base", "has_constructor", "status"])
    own = settle(own.select("name", "base", F.coalesce("has_constructor", F.lit(False)).alias("has_constructor"), "status"))
    ends = chain_ends(own.where("not has_constructor").select("name", F.col("base").alias("target")), most)
    decided = own.select("name", F.when(F.col("has_constructor"), F.col("name")).alias("_self")).join(ends, "name", "left")
    decided = decided.select("name", F.coalesce("_self", "end").alias("end"))
    status = own.where("has_constructor and status between 100 and 599").select(F.col("name").alias("end"), "status")
    return decided.join(status, "end", "left").select("name", "status")


def constant_texts(constants: DataFrame, most: int = 3) -> DataFrame:
    """(name, text): the literal that each constant stands for, through at most ``most`` other constants.

    ``constants`` has name, text (the literal that initialises it, or null) and
    target (the constant that does, or null). A text counts before a target.
    """
    direct = constants.where("name is not null").groupBy("name").agg(F.min("text").alias("text"))
    ends = chain_ends(constants.join(direct.where("text is not null").select("name"), "name", "left_anti"), most)
    read = direct.where("text is not null").select(F.col("name").alias("end"), F.col("text").alias("_text"))
    far = ends.join(read, "end").select("name", "_text")
    return direct.join(far, "name", "left").select("name", F.coalesce("text", "_text").alias("text"))
