"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b longs) the smallest node it is connected with.

    Each round hooks every node to the neighbour of least random priority and
    contracts, so that the number of rounds is logarithmic even for long chains.
    Self-links, repeated links and an empty table are fine.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialize(edges.where("a is not null and b is not null").distinct(), "links")
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    edges = edges.where("a <> b")
    round_ = 0
    while not edges.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.lit(round_), c).alias("p"), F.col(c).alias("id"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("n"), ranked("b").alias("to")), F.struct(F.col("b").alias("n"), ranked("a").alias("to"))))
        hooks = edges.select(ends.alias("e")).groupBy("e.n").agg(F.min("e.to").alias("to"))
        hooks = materialize(hooks.select("n", F.least(ranked("n"), "to").getField("id").alias("parent")), "hooks")
        ha, hb = hooks.toDF("a", "pa"), hooks.toDF("b", "pb")
        edges = edges.join(ha, "a").join(hb, "b").where("pa <> pb")
        edges = materialize(edges.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        labels = labels.join(hooks.toDF("root", "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        labels = materialize(labels, "labels")
        round_ += 1
    least = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(least, "root").select("node", "component")
