"""Index passes over facts as they arrive: each micro-batch of a stream of fact files is one pass.

What decides whether facts are late is part of the published version, not of the
stream's checkpoint: a table ``marks`` has for each path the time of what was
taken in last, for removed files too. So a batch that runs again after a crash,
or a second stream started on the same files, finds its own marks and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relational
from ..operators.graph import settle
from ..sources.facts import FACTS
from ..sources.snapshot import SnapshotStore

#: Facts as a stream has them: ``at`` says when they were true, ``removed`` that the file is gone since then (it then needs a path only).
EVENTS = FACTS + ", at timestamp, removed boolean"


def stream_facts(spark, folder: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(EVENTS).format(form).load(folder)


def _age() -> Column:
    """Of two events of a path the later one counts; at the same time a removal, then the hash that sorts last."""
    return F.struct("at", "removed", "hash")


def newest(batch: DataFrame, marks: DataFrame | None) -> DataFrame:
    """The batch's latest event of each path unless ``marks`` (path, at, removed, hash) has a later one, with ``news``: whether it is later than the mark.

    Events without a time count as later than all others and leave no mark;
    those without a path are dropped.
    """
    for name, kind in (("at", "timestamp"), ("removed", "boolean")):
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast(kind))
    events = batch.where("path is not null").withColumns({"removed": F.coalesce("removed", F.lit(False)), "hash": F.coalesce("hash", F.lit(""))})
    latest = relational.keep_first(events, ["path"], [F.desc(F.col("at").isNull()), F.desc(_age())])
    if marks is None:
        return latest.withColumn("news", F.col("at").isNotNull())
    held = latest.join(marks.select("path", _age().alias("_mark")), "path", "left")
    held = held.where(F.col("at").isNull() | F.col("_mark").isNull() | (_age() >= F.col("_mark")))
    return held.withColumn("news", F.col("at").isNotNull() & (F.col("_mark").isNull() | (_age() > F.col("_mark")))).drop("_mark")


def apply_batch(store: SnapshotStore, batch: DataFrame) -> None:
    """Apply a batch of facts and removals; files that it does not name stay as they are.

    Late and repeated events change nothing, and a batch of such publishes
    nothing. Facts with the hash that the index has only move the file's mark.
    """
    old = store.current()
    latest = settle(newest(batch, old.tables.get("marks") if old else None))
    facts, gone = latest.where("not removed"), latest.where("removed").select("path")
    if old is not None:
        files = old["files"].select("path", F.col("hash").alias("_hash"), F.lit(True).alias("_had"))
        facts = facts.join(files, "path", "left").where(F.col("_had").isNull() | (F.coalesce("_hash", F.lit("")) != F.col("hash")))
        gone = gone.join(files, "path", "left_semi")
    facts = facts.drop("at", "removed", "news", "_hash", "_had")
    marks = latest.where("news").select("path", "at", "removed", "hash")
    if (not latest.isEmpty()) if old is None else not (facts.isEmpty() and gone.isEmpty()):
        store.apply(facts, gone, marks=marks)
    elif not marks.isEmpty():
        store.change({"marks": marks}, {"marks": {"path": marks.select("path")}})


def start(facts: DataFrame, store: SnapshotStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run passes for a stream of facts; with ``once`` stop when what is there has been taken in."""
    writer = facts.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
