"""Versions of the stored schema: steps forward and back over the tables of an index.

A migration is published like any pass: all of it or nothing, and not over
another writer's version. How many steps an index has taken is one of its settings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .snapshot import SETTINGS, Snapshot, SnapshotStore

VERSION = "schema_version"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Migration:
    """``up`` and ``down`` give the tables anew; with ``rereads`` only the sources can fill what ``up`` adds."""

    name: str
    up: Callable[[Tables], Tables]
    down: Callable[[Tables], Tables]
    rereads: bool = False


def new_table(name: str, schema: str, rereads: bool = False) -> Migration:
    """An empty table more; going back drops it."""

    def up(tables: Tables) -> Tables:
        spark = tables["files"].sparkSession
        return tables | {name: spark.createDataFrame([], schema)}

    return Migration(f"table {name}", up, lambda tables: {n: t for n, t in tables.items() if n != name}, rereads)


def new_columns(table: str, types: dict[str, str], rereads: bool = False) -> Migration:
    """Further columns of a table, null in the rows there are; going back drops them."""
    empty = {name: F.lit(None).cast(type_) for name, type_ in types.items()}
    return Migration(
        f"columns {', '.join(types)} of {table}",
        lambda tables: tables | {table: tables[table].withColumns(empty)},
        lambda tables: tables | {table: tables[table].drop(*types)},
        rereads,
    )


def version_of(snapshot: Snapshot) -> int:
    """How many migrations the snapshot has taken."""
    row = snapshot["settings"].where(F.col("key") == VERSION).first()
    return int(row.value) if row else 0


def migrate(store: SnapshotStore, migrations: list[Migration], to: int | None = None) -> Snapshot | None:
    """Bring the published index to ``to`` migrations (all by default), forward or back; None without an index.

    Where a step forward rereads, all file hashes are blanked, so that the next
    pass takes every file for changed. ValueError where the index has taken more
    steps than are known, or ``to`` is no such number. Nothing to do publishes nothing.
    """
    old = store.current()
    if old is None:
        return None
    have, wanted = version_of(old), len(migrations) if to is None else to
    if not 0 <= wanted <= len(migrations) or have > len(migrations):
        raise ValueError(f"cannot go from version {have} to {wanted} with {len(migrations)} migrations")
    if have == wanted:
        return old
    tables = dict(old.tables)
    for step in migrations[have:wanted]:
        tables = step.up(tables)
    for step in reversed(migrations[wanted:have]):
        tables = step.down(tables)
    if any(step.rereads for step in migrations[have:wanted]):
        tables["files"] = tables["files"].withColumn("hash", F.lit(""))
    number = store.spark.createDataFrame([(VERSION, str(wanted))], SETTINGS)
    tables["settings"] = tables["settings"].where(F.col("key") != VERSION).unionByName(number)
    return store.publish(tables, old.version)
