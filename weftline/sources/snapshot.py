"""Versioned tables of an index: what a pass changes becomes levels of a new version, which one pointer file then names.

Parquet has no transactions. A pass writes the rows that it adds and the keys
that it takes away into a folder of its own, then a manifest that says which
folders make up the version, and puts a numbered pointer file beside the others
last; readers follow the largest, so they see all of a pass or nothing of it.
A version stays readable for the next KEPT - 1 passes; a reader that holds one for
longer finds its files gone, and asks for the current one again.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, relational, routes
from . import facts as facts_io
from . import levels
from .levels import Gone, Level, Stored

BASE = facts_io.TABLES
DERIVED = ["routes", "middleware", "route_warnings", "cross_edges"]
#: What tells which rows of a table a pass replaces; tables that migrations add are kept whole.
KEYS = dict.fromkeys(BASE, "file") | {"files": "path", "routes": "route", "middleware": "route", "route_warnings": "key", "cross_edges": "api_call_id", "marks": "path"}
#: Tables whose rows a file keeps when only what its symbols do is read again.
OF_TEXT = ("files", "symbols", "imports", "declarations")
SETTINGS = "key string, value string"
POINTERS = "pointers"
#: Versions that stay readable.
KEPT = 3
#: Tables that one pass writes at a time.
WRITERS = 4
#: Folders that no version names are another writer's for so long, in seconds.
GRACE = 24 * 3600


class VersionConflict(RuntimeError):
    """Another writer published first."""


@dataclass
class Snapshot:
    """The tables of one version by name."""

    tables: dict[str, DataFrame]
    version: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


@dataclass
class Manifest:
    """What makes up a version. File hashes of levels before ``blanked`` count as empty; ``pins`` is the digest of those that links were made with."""

    number: int
    tables: dict[str, Stored] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)
    blanked: int = 0
    pins: str = ""

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "settings": self.settings, "blanked": self.blanked, "pins": self.pins, "tables": {n: t.told() for n, t in self.tables.items()}})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        told = json.loads(text)
        return cls(told["number"], {n: Stored.of(t) for n, t in told["tables"].items()}, told["settings"], told["blanked"], told["pins"])

    def folders(self) -> set[str]:
        """The folders, one for each pass, that the version reads."""
        return {f.split("/")[0] for t in self.tables.values() for f in t.folders()}


class SnapshotStore:
    """Snapshots under a directory that all of the cluster reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path(POINTERS).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self._fs().listStatus(path)] if self._fs().exists(path) else []

    def _number(self) -> int:
        """The number of the newest pointer, 0 before the first."""
        return max((int(n) for n in self._names(POINTERS) if n.isdigit()), default=0)

    def _text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        stream = self._fs().create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _read(self, number: int) -> str:
        return self._text(f"{POINTERS}/{number:012d}")

    def _manifest(self, version: str) -> Manifest:
        return Manifest.from_json(self._text(f"{version}/manifest.json"))

    def _now(self) -> tuple[str, Manifest] | None:
        number = self._number()
        if not number:
            return None
        version = self._read(number)
        return version, self._manifest(version)

    def _view(self, manifest: Manifest, version: str | None = None) -> Snapshot:
        tables = {n: self._table(manifest, n) for n in manifest.tables}
        tables["settings"] = self.spark.createDataFrame(sorted(manifest.settings.items()), SETTINGS)
        return Snapshot(tables, version)

    def _table(self, manifest: Manifest, name: str, keys: list[str] | None = None) -> DataFrame:
        stored = manifest.tables[name]
        if name != "files" or not manifest.blanked:
            return levels.read(self.spark, self.root, stored, keys)
        old = Stored(stored.key, stored.schema, [x for x in stored.rows if x.number < manifest.blanked], stored.gone)
        new = Stored(stored.key, stored.schema, [x for x in stored.rows if x.number >= manifest.blanked], stored.gone)
        return levels.read(self.spark, self.root, old, keys).withColumn("hash", F.lit("")).unionByName(levels.read(self.spark, self.root, new, keys))

    def current(self) -> Snapshot | None:
        """The published version, None before the first."""
        now = self._now()
        return now and self._view(now[1], now[0])

    def rows_of(self, name: str, keys: list[str]) -> DataFrame:
        """Rows of a table of the published version whose key (its file, for facts) is among ``keys``: only their buckets are read."""
        now = self._now()
        if now is None:
            raise KeyError(name)
        return self._table(now[1], name, list(keys))

    def _publish(self, manifest: Manifest, after: str | None, fresh: str) -> Snapshot:
        """Point to a version whose data are written; VersionConflict, and no trace of ``fresh``, if another got the number first.

        The pointer's name is the next number. It is written aside and renamed,
        and a rename never replaces a file, so of two writers one fails. Versions
        before the last KEPT are deleted, with the folders that only they read.
        """
        jvm, fs, number = self.spark._jvm, self._fs(), manifest.number
        version = f"v-{uuid.uuid4().hex}"
        self._write_text(f"{version}/manifest.json", manifest.to_json())
        aside, path = f"{POINTERS}/.{version}", self._path(f"{POINTERS}/{number:012d}")
        self._write_text(aside, version)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(aside), path, options)
        except Py4JJavaError as error:
            for name in (aside, version, fresh):
                fs.delete(self._path(name), True)
            raise VersionConflict(f"{path} was published by another writer (instead of one after {after})") from error
        self._forget(number - KEPT)
        return self._view(manifest, version)

    def _forget(self, up_to: int) -> None:
        fs, numbers = self._fs(), sorted(int(n) for n in self._names(POINTERS) if n.isdigit())
        old = [n for n in numbers if n <= up_to]
        if not old:
            return
        needed = {f for n in numbers if n > up_to for f in self._manifest(self._read(n)).folders()}
        for number in old:
            version = self._read(number)
            for folder in (self._manifest(version).folders() if self._fs().exists(self._path(f"{version}/manifest.json")) else set()) - needed:
                fs.delete(self._path(folder), True)
            fs.delete(self._path(version), True)
            fs.delete(self._path(f"{POINTERS}/{number:012d}"), False)

    def sweep(self, grace: float = GRACE) -> list[str]:
        """Delete what crashed writers have left: folders older than ``grace`` seconds that no kept version names. Their names."""
        numbers = [int(n) for n in self._names(POINTERS) if n.isdigit()]
        versions = {self._read(n) for n in numbers}
        needed = versions | {f for v in versions for f in self._manifest(v).folders()} | {POINTERS}
        before = (time.time() - grace) * 1000
        left = [n for n in self._names("") if n not in needed and n.startswith(("v-", "d-"))] if numbers else []
        left += [f"{POINTERS}/{n}" for n in self._names(POINTERS) if n.startswith(".v-")]
        swept = [n for n in left if self._fs().getFileStatus(self._path(n)).getModificationTime() <= before]
        for name in swept:
            self._fs().delete(self._path(name), True)
        return sorted(swept)

    def publish(self, tables: dict[str, DataFrame], after: str | None = None) -> Snapshot:
        """Write all tables anew as one level and point to them; VersionConflict if another than ``after`` is published by then."""
        number = self._number()
        if (self._read(number) if number else None) != after:
            raise VersionConflict(f"{self.root} has a newer version than {after}")
        manifest, fresh = Manifest(number + 1), f"d-{uuid.uuid4().hex}"
        if "settings" in tables:
            manifest.settings = dict(map(tuple, tables["settings"].collect()))
        self._add_all(manifest, fresh, {name: (frame, {}) for name, frame in tables.items() if name != "settings"})
        return self._publish(manifest, after, fresh)

    def _add_all(self, manifest: Manifest, fresh: str, tables: dict[str, tuple[DataFrame, dict[str, DataFrame]]]) -> None:
        """``_add`` for several tables, whose jobs run side by side."""
        with ThreadPoolExecutor(WRITERS) as pool:
            for made in [pool.submit(self._add, manifest, fresh, name, rows, lost, KEYS.get(name)) for name, (rows, lost) in tables.items()]:
                made.result()

    def _add(self, manifest: Manifest, fresh: str, name: str, rows: DataFrame, gone: dict[str, DataFrame], key: str | None = None) -> None:
        """A level more of a table in the manifest: ``rows``, and by column the keys (a DataFrame of one column) that earlier levels lose."""
        stored = manifest.tables.get(name)
        if stored is None:
            stored = manifest.tables[name] = Stored(key, rows.schema.json())
        else:
            rows = levels.aligned(rows, stored.type())
        for i, (column, keys) in enumerate(gone.items()):
            folder = f"{fresh}/{name}-gone-{i}"
            keys.toDF("_key").select(F.col("_key").cast("string")).distinct().write.parquet(f"{self.root}/{folder}")
            stored.gone.append(Gone(manifest.number, folder, column))
        size = levels.write_rows(rows, stored.key, f"{self.root}/{fresh}/{name}")
        if size:
            stored.rows.append(Level(manifest.number, f"{fresh}/{name}", size))
        if len(stored.rows) > levels.MOST_LEVELS and not (name == "files" and manifest.blanked):
            manifest.tables[name] = levels.merged(self.spark, self.root, stored, manifest.number, f"{fresh}/{name}-merged")

    def change(self, rows: dict[str, DataFrame], gone: dict[str, dict[str, DataFrame]]) -> Snapshot:
        """One pass over any tables of the published version: ``gone`` by table and column the keys whose rows go, ``rows`` what comes."""
        version, manifest = self._now()
        fresh = f"d-{uuid.uuid4().hex}"
        manifest.number += 1
        for name in {**rows, **gone}:
            known = levels.read(self.spark, self.root, manifest.tables[name]).limit(0) if name not in rows else rows[name]
            self._add(manifest, fresh, name, known, gone.get(name, {}), KEYS.get(name))
        return self._publish(manifest, version, fresh)

    def drop(self) -> None:
        self._fs().delete(self._path(POINTERS).getParent(), True)

    def apply(self, facts: DataFrame, removed: DataFrame | list[str] = (), refreshed: DataFrame | list[str] = (), pins: DataFrame | None = None, settings: dict[str, str] | None = None, marks: DataFrame | None = None) -> Snapshot:
        """One index pass: replace the facts of files, drop removed files, rebuild the calls of refreshed ones, derive routes and links.

        ``facts`` of a path in ``refreshed`` replace only what its symbols do;
        the symbols themselves stay. Raises FactsError, and publishes nothing,
        if facts belong to unknown symbols. Tables and columns that migrations
        have added stay; new rows are null there. Written is what the pass
        changes, routes and links included. ``marks`` (path and any more columns)
        replace those of their paths in a table of that name, in the same version.
        """
        fresh = f"d-{uuid.uuid4().hex}"
        try:
            return self._apply(fresh, facts, removed, refreshed, pins, settings, marks)
        except Exception:
            self._fs().delete(self._path(fresh), True)
            raise

    def _apply(self, fresh: str, facts: DataFrame, removed, refreshed, pins: DataFrame | None, settings: dict[str, str] | None, marks: DataFrame | None) -> Snapshot:
        now = self._now()
        removed, refreshed = (x if isinstance(x, DataFrame) else self.spark.createDataFrame([(p,) for p in x], "path string") for x in (removed, refreshed))
        pinned = "" if pins is None else hashlib.sha256(json.dumps(sorted(map(list, pins.collect())), default=str).encode()).hexdigest()
        if now is None:
            tables = facts_io.expand(facts)
            manifest = Manifest(1, settings=dict(settings or {}), pins=pinned)
            self._add_all(manifest, fresh, {n: (rows, {}) for n, rows in tables.items()})
            self._add_all(manifest, fresh, {n: (rows, {}) for n, rows in derive(self._view(manifest).tables, pins).items()})
            self._mark(manifest, fresh, marks)
            return self._publish(manifest, None, fresh)
        version, manifest = now
        old = self._view(manifest, version)
        manifest = Manifest(manifest.number + 1, {n: Stored.of(t.told()) for n, t in manifest.tables.items()}, manifest.settings | (settings or {}), manifest.blanked, pinned)
        replaced = facts.join(refreshed, "path", "left_anti")
        gone = graph.settle(replaced.select("path").unionByName(removed).distinct())
        touched = graph.settle(gone.unionByName(refreshed).distinct())
        new, whole, ids = self._replacing(old, facts, replaced, gone)
        lost = {name: {KEYS[name]: gone if name in OF_TEXT else touched} for name in BASE}
        # an edge into a file that was replaced is gone until its caller is refreshed
        lost["calls"]["callee_id"] = ids.where("had and not has").select("symbol_id")
        self._add_all(manifest, fresh, {name: ((whole if name in OF_TEXT else new)[name], lost[name]) for name in BASE})
        if any(name not in manifest.tables for name in DERIVED):
            self._add_all(manifest, fresh, {n: (rows, {}) for n, rows in derive(self._view(manifest).tables, pins).items()})
        else:
            self._derive(manifest, fresh, old, touched, ids, pins, relink=pinned != self._manifest(version).pins)
        self._mark(manifest, fresh, marks)
        return self._publish(manifest, version, fresh)

    def _mark(self, manifest: Manifest, fresh: str, marks: DataFrame | None) -> None:
        if marks is not None:
            self._add(manifest, fresh, "marks", marks, {"path": marks.select("path")}, KEYS["marks"])

    def _replacing(self, old: Snapshot, facts: DataFrame, replaced: DataFrame, gone: DataFrame) -> tuple[dict, dict, DataFrame]:
        """Tables of all facts and of replaced files alone, and which symbols (symbol_id, had, has) come or go."""
        stay = relational.without(old["symbols"], gone, "file")
        whole = facts_io.expand(replaced, resolve_in=stay, checked=False)
        new = facts_io.expand(facts, resolve_in=stay, checked=False)
        facts_io.check_owners(new, stay.select("symbol_id").unionByName(whole["symbols"].select("symbol_id")))
        before = relational.within(old["symbols"], gone, "file").select("symbol_id", F.lit(True).alias("had"))
        after = whole["symbols"].select("symbol_id").distinct().withColumn("has", F.lit(True))
        both = before.join(after, "symbol_id", "full_outer").select("symbol_id", F.coalesce("had", F.lit(False)).alias("had"), F.coalesce("has", F.lit(False)).alias("has"))
        return new, whole, graph.settle(both.where("had <> has"))

    def _derive(self, manifest: Manifest, fresh: str, old: Snapshot, touched: DataFrame, ids: DataFrame, pins: DataFrame | None, relink: bool) -> None:
        """Derived tables after a pass: what hangs on changed registrations, calls and routes is made again, all else stays."""
        new = self._view(manifest)
        change = changed_routes(old, new, touched, ids)
        if change is not None:
            self._add_all(manifest, fresh, {name: (rows, {KEYS[name]: lost}) for name, (rows, lost) in change.items()})
            new = self._view(manifest)
        links = changed_links(old, new, touched, pins, relink)
        if links is not None:
            self._add(manifest, fresh, "cross_edges", links[0], {"api_call_id": links[1]})

    def invalidate(self, key: str, value: str) -> Snapshot:
        """Blank all file hashes, so that the next pass takes every file for changed, and record the setting; no table is written."""
        version, manifest = self._now()
        manifest.number += 1
        manifest.blanked = manifest.number
        manifest.settings[key] = value
        return self._publish(manifest, version, f"d-{uuid.uuid4().hex}")


def plan_pass(snapshot: Snapshot | None, present: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed, removed, refreshed) paths of a pass over ``present`` (path, hash).

    Refreshed are the present files that import, call or register what lives in a
    changed or removed file, unless they are such themselves.
    """
    if snapshot is None:
        none = present.select("path").limit(0)
        return present.select("path"), none, none
    found = relational.changes(snapshot["files"], present, "path", "hash")
    changed, removed = found.where("change <> 'removed'").select("path"), found.where("change = 'removed'").select("path")
    touched = found.select("path")
    hit = importers(snapshot, touched).unionByName(caller_files(snapshot, touched)).unionByName(registering_files(snapshot, touched)).distinct()
    refreshed = hit.join(touched, "path", "left_anti").join(present.select("path"), "path", "left_semi")
    return changed, removed, refreshed


def importers(snapshot: Snapshot, paths: DataFrame) -> DataFrame:
    """(path): files that import any of ``paths`` (path)."""
    return snapshot["imports"].join(paths.toDF("resolved_path"), "resolved_path", "left_semi").select(F.col("file").alias("path")).distinct()


def caller_files(snapshot: Snapshot, paths: DataFrame) -> DataFrame:
    """(path): other files with a call into a symbol of ``paths`` (path)."""
    inside = snapshot["symbols"].join(paths.toDF("file"), "file", "left_semi").select(F.col("symbol_id").alias("callee_id"))
    hit = snapshot["calls"].join(inside, "callee_id", "left_semi").select(F.col("file").alias("path")).distinct()
    return hit.join(paths, "path", "left_anti")


def registering_files(snapshot: Snapshot, paths: DataFrame) -> DataFrame:
    """(path): other files whose registrations name a function of ``paths`` (path)."""
    named = snapshot["router_calls"].select(F.col("file").alias("path"), F.explode("handlers").alias("h"))
    named = named.select("path", F.explode(F.array("h.key.file", "h.factory.file")).alias("f")).where("f is not null")
    return named.join(paths.toDF("f"), "f", "left_semi").select("path").distinct().join(paths, "path", "left_anti")


def placed(stitched: tuple[DataFrame, DataFrame, DataFrame], symbols: DataFrame) -> dict[str, DataFrame]:
    """Stitched routes, middleware and warnings with the symbols (symbol_id) that their handlers run."""
    found, middleware, warnings = stitched
    symbols = symbols.select("symbol_id")
    there = found.select("route", "method", "full_path", "file", "line", "end_line", "mount_chain", "warnings", "receivers", routes.handler_label(F.col("handler")).alias("handler_label"), facts_io.key_id(routes.handler_key(F.col("handler"))).alias("_id"))
    there = there.join(symbols.select(F.col("symbol_id").alias("handler_id")), F.col("_id") == F.col("handler_id"), "left").drop("_id")
    chain = middleware.select("route", "order_idx", "phase", "file", "line", "end_line", routes.handler_label(F.col("handler")).alias("label"), routes.handler_note(F.col("handler"), F.col("file"), F.col("line")).alias("unresolved_note"), facts_io.key_id(routes.handler_key(F.col("handler"))).alias("_id"))
    chain = chain.join(symbols, F.col("_id") == F.col("symbol_id"), "left").drop("_id")
    return {"routes": there, "middleware": chain, "route_warnings": warnings}


def _linked(tables: dict[str, DataFrame], calls: DataFrame, pins: DataFrame | None) -> DataFrame:
    """Edges of API calls (rows of that table) to all routes."""
    callers = tables["symbols"].select("symbol_id", F.concat_ws("#", "file", "name").alias("caller"))
    asking = calls.join(callers, "symbol_id").select(F.col("api_call_id").alias("call_id"), "method", "url_pattern", "caller")
    targets = tables["routes"].select(F.col("route").alias("route_id"), "method", "full_path")
    return routes.cross_edges(asking, targets, pins).withColumnsRenamed({"call_id": "api_call_id", "route_id": "route"})


def derive(tables: dict[str, DataFrame], pins: DataFrame | None = None) -> dict[str, DataFrame]:
    """The derived tables: routes, middleware and warnings from registrations, cross edges from API calls."""
    made = placed(routes.stitch(tables["router_calls"]), tables["symbols"])
    return made | {"cross_edges": _linked(tables | {"routes": made["routes"]}, tables["api_calls"], pins)}


def changed_routes(old: Snapshot, new: Snapshot, touched: DataFrame, ids: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]] | None:
    """By table the new rows, and the keys whose old rows they replace, after a pass over ``touched`` (path); None if nothing hangs on it.

    Marked are the receivers with registrations in touched files or of handlers
    that came or went (``ids``), before or after, and what they mount. A route
    depends on the receivers on its way alone, so only routes whose way meets a
    marked one are stitched again: from the receivers below marked ones, and all
    above these, which is all that their ways can lead through.
    """
    files = touched.toDF("file")
    both = [t["router_calls"] for t in (old, new)]
    registered = [t.join(files, "file", "left_semi").select("receiver_key", "file") for t in both]
    handlers = [t.select("receiver_key", "file", F.explode("handlers").alias("h")).withColumn("symbol_id", facts_io.key_id(routes.handler_key(F.col("h")))).join(ids.select("symbol_id"), "symbol_id", "left_semi").select("receiver_key", "file") for t in both]
    changed = graph.settle(registered[0].unionByName(registered[1]).unionByName(handlers[0]).unionByName(handlers[1]).distinct())
    if changed.isEmpty():
        return None
    edges = graph.settle(routes.mount_edges(both[0]).unionByName(routes.mount_edges(both[1])).distinct())
    own = changed.where("receiver_key is not null").select(F.col("receiver_key").alias("node"))
    marked = graph.settle(own.unionByName(edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))).distinct())
    below = graph.spread(edges, marked)
    around = graph.spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), below)
    rows = new["router_calls"]
    loose = changed.where("receiver_key is null").select("file").distinct()
    part = rows.join(around.withColumnRenamed("node", "receiver_key"), "receiver_key", "left_semi").select(rows.columns)
    part = part.unionByName(rows.where("receiver_key is null").join(loose, "file", "left_semi").select(rows.columns))
    made = placed(routes.stitch(graph.settle(part)), new["symbols"])
    meets = lambda t: t.select("route", F.explode("receivers").alias("node")).join(marked, "node", "left_semi").select("route").distinct()
    stitched = graph.settle(made["routes"])
    fresh = graph.settle(meets(stitched))
    lost = graph.settle(meets(old["routes"]).unionByName(fresh).distinct())
    warned = graph.settle(below.select(F.col("node").alias("key")).unionByName(loose.select(routes.loose_key(F.col("file")).alias("key"))))
    return {
        "routes": (stitched.join(fresh, "route", "left_semi"), lost),
        "middleware": (made["middleware"].join(fresh, "route", "left_semi"), lost),
        "route_warnings": (made["route_warnings"].join(warned, "key", "left_semi"), warned),
    }


def changed_links(old: Snapshot, new: Snapshot, touched: DataFrame, pins: DataFrame | None, relink: bool) -> tuple[DataFrame, DataFrame] | None:
    """The edges to write, and the calls whose old ones they replace; None if no call has to be asked again.

    Asked again are the calls of touched files, those that led to a route that
    is gone, those that a new route fits, and those pinned to either; with
    ``relink`` all.
    """
    files, calls = touched.toDF("file"), new["api_calls"]
    here = lambda t: t.join(files, "file", "left_semi").select("api_call_id")
    if relink:
        again = old["api_calls"].select("api_call_id").unionByName(calls.select("api_call_id")).distinct()
    else:
        form = lambda t: t.select("route", "method", "full_path")
        had, has = form(old["routes"]), form(new["routes"])
        came, went = graph.settle(has.join(had, had.columns, "left_anti")), graph.settle(had.join(has, has.columns, "left_anti"))
        fitting = routes.candidates(calls.select(F.col("api_call_id").alias("call_id"), "method", "url_pattern"), came.withColumnRenamed("route", "route_id"))
        again = here(old["api_calls"]).unionByName(here(calls)).unionByName(fitting.select(F.col("call_id").alias("api_call_id")))
        again = again.unionByName(old["cross_edges"].join(went, "route", "left_semi").select("api_call_id"))
        if pins is not None:
            named = came.unionByName(went).select(F.concat_ws(" ", "method", "full_path").alias("route")).distinct()
            asked = pins.join(named, "route", "left_semi").select("caller", "method", F.col("url").alias("url_pattern")).distinct()
            callers = new["symbols"].select("symbol_id", F.concat_ws("#", "file", "name").alias("caller"))
            again = again.unionByName(calls.join(callers, "symbol_id").join(asked, ["caller", "method", "url_pattern"], "left_semi").select("api_call_id"))
        again = graph.settle(again.distinct())
        if again.isEmpty():
            return None
    return _linked(new.tables, relational.within(calls, again, "api_call_id"), pins), again
