"""One index of one repository: passes over facts, and queries about functions, files, endpoints, components and requests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.text import split_lines
from .operators import contexts, relational, render, routes
from .operators.graph import settle
from .sources.snapshot import Snapshot, SnapshotStore, plan_pass

PINS = "caller string, method string, url string, route string, position int"


class Engine:
    """Queries take any number of targets and return tables; the ``*_text`` methods render one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, SnapshotStore(spark, f"{folder.rstrip('/')}/index")

    # --- the index ---

    def pins(self, pins: list) -> DataFrame:
        rows = [(p.caller, p.method, p.url, p.route, i) for i, p in enumerate(pins)]
        return self.spark.createDataFrame(rows, PINS)

    def index(self, facts: DataFrame, pins: list = (), settings: dict | None = None) -> dict[str, int]:
        """One incremental pass over the facts of all present files; {changed, removed, refreshed}.

        Facts are read for what changed and what depends on it. Other settings than
        last time make every file count as changed; a pass that finds nothing to do
        publishes nothing, unless the pins differ.
        """
        digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, default=vars).encode()).hexdigest()
        wanted = {"extraction": digest(settings or {}), "pins": digest(list(pins))}
        old = self.store.current()
        had = dict(map(tuple, old["settings"].collect())) if old else {}
        if old and had.get("extraction") != wanted["extraction"]:
            old = self.store.invalidate("extraction", wanted["extraction"])
        changed, removed, refreshed = (settle(x) for x in plan_pass(old, facts.select("path", "hash")))
        counts = {name: x.count() for name, x in (("changed", changed), ("removed", removed), ("refreshed", refreshed))}
        if counts["changed"] or counts["removed"] or old is None or had.get("pins") != wanted["pins"]:
            asked = facts.join(changed.unionByName(refreshed), "path", "left_semi")
            self.store.apply(asked, removed, refreshed, self.pins(pins), wanted)
        return counts

    def snapshot(self) -> Snapshot:
        found = self.store.current()
        if found is None:
            raise contexts.TargetError("nothing is indexed yet")
        return found

    def tables(self) -> dict[str, DataFrame]:
        return self.snapshot().tables

    def stats(self) -> Row:
        return contexts.index_stats(self.tables()).first()

    @staticmethod
    def lines(files: DataFrame) -> DataFrame:
        """(file, lines, hash) of source texts (path, text, hash)."""
        return files.select(F.col("path").alias("file"), split_lines("text").alias("lines"), "hash")

    # --- lookups ---

    def symbols_in(self, files: list[str]) -> DataFrame:
        return contexts.symbols_with_ids(self.tables()).where(F.col("file").isin(files)).orderBy("file", "start_line", F.desc("end_line"))

    def symbols_in_range(self, file: str, start: int, end: int) -> DataFrame:
        return self.symbols_in([file]).where((F.col("start_line") <= end) & (F.col("end_line") >= start))

    def find_symbol(self, file: str, name: str) -> DataFrame:
        return self.symbols_in([file]).where(F.col("name") == name)

    def callers(self, symbols: DataFrame) -> DataFrame:
        """Call sites of symbols (symbol_id) with the calling symbol."""
        t = self.tables()
        calls = t["calls"].join(symbols.select(F.col("symbol_id").alias("callee_id")), "callee_id", "left_semi")
        return calls.select("callee_id", F.col("caller_id").alias("symbol_id"), "call_line").join(contexts.symbols_with_ids(t), "symbol_id")

    def side_effects(self, symbols: DataFrame) -> DataFrame:
        return relational.within(self.tables()["side_effects"], symbols.select("symbol_id"), "symbol_id").orderBy("symbol_id", "line", "position")

    def api_calls(self, symbols: DataFrame | None = None) -> DataFrame:
        calls = self.tables()["api_calls"]
        return calls if symbols is None else relational.within(calls, symbols.select("symbol_id"), "symbol_id")

    def routes(self) -> DataFrame:
        return self.tables()["routes"].orderBy("full_path", "method", "file", "line")

    def closest_routes(self, requests: DataFrame, n: int = 5) -> DataFrame:
        table = self.tables()["routes"].select(F.col("route").alias("route_id"), "method", "full_path")
        return routes.closest_routes(requests, table, n)

    # --- contexts ---

    def fn(self, targets: DataFrame, lines: DataFrame, depth: int = 2, tokens: int = 60_000) -> dict[str, DataFrame]:
        return contexts.fn_context(self.tables(), lines, targets, depth, tokens)

    def file(self, lines: DataFrame) -> dict[str, DataFrame]:
        return contexts.file_context(self.tables(), lines)

    def endpoint(self, requests: DataFrame, lines: DataFrame, depth: int = 3, tokens: int = 60_000) -> dict[str, DataFrame]:
        return contexts.endpoint_context(self.tables(), lines, requests, depth, tokens)

    def component(self, targets: DataFrame, lines: DataFrame, depth: int = 2, tokens: int = 60_000) -> dict[str, DataFrame]:
        return contexts.component_context(self.tables(), lines, targets, depth, tokens)

    def trace(self, requests: DataFrame, lines: DataFrame, depth: int = 3, tokens: int = 60_000) -> dict[str, DataFrame]:
        return contexts.trace_context(self.tables(), lines, requests, depth, tokens)

    # --- text ---

    def endpoint_text(self, method: str, path: str, lines: DataFrame) -> tuple[str, list[str]]:
        """The diagram and the notes of one endpoint."""
        request = self.spark.createDataFrame([("t", method, path)], "target string, method string, path string")
        got = self.endpoint(request, lines)
        return self._endpoint_text(got)

    def _endpoint_text(self, got: dict[str, DataFrame]) -> tuple[str, list[str]]:
        found = got["found"].first()
        if found.error:
            raise contexts.TargetError(found.error)
        names = contexts.symbols_with_ids(self.tables()).select("symbol_id", "name", "file", "kind")
        rows = lambda frame: [r.asDict(recursive=True) for r in frame.collect()]
        route = rows(self.tables()["routes"].where(F.col("route") == found.route))[0]
        chain = rows(got["chain"].orderBy("position"))
        callees = rows(got["callees"].where("callee_id is not null").join(names.withColumnRenamed("symbol_id", "callee_id"), "callee_id").orderBy("depth", "call_line"))
        effects = rows(got["effects"].join(names, "symbol_id").orderBy("nth"))
        errors = rows(got["error_paths"].join(names, "symbol_id").orderBy("nth"))
        warnings = list(route["warnings"]) + [r.message for r in self.tables()["route_warnings"].orderBy("message").collect()]
        diagram = render.endpoint_diagram(route, [n for n in chain if n["phase"] != "error"], callees, effects, errors)
        return diagram, render.endpoint_notes(route, chain, effects, errors, warnings)

    def trace_text(self, method: str, path: str, lines: DataFrame, component: str | None = None) -> tuple[str, list[str]]:
        """The diagram and the notes of one request from user action to response."""
        request = self.spark.createDataFrame([("t", method, path, component)], "target string, method string, path string, component string")
        got = self.trace(request, lines)
        found, pick = got["found"].first(), got["picks"].first()
        if found.error or pick.error:
            kind = contexts.PinNeeded if pick is not None and pick.error and "pin" in pick.error else contexts.TargetError
            raise kind(found.error or pick.error)
        server, notes = self._endpoint_text(got["endpoint"])
        call = got["link"].first()
        ways = [r.asDict() for r in got["component"]["triggers"].where(F.col("api_call_id") == pick.api_call_id).orderBy("kind", "place", "label").collect()]
        ways.sort(key=lambda w: (w["kind"] != "event", w["place"], w["label"]))
        after = [r.callee_text for r in got["after_response"].orderBy("line").collect()]
        # the symbols that the diagram names: the component, the caller, and what the shown path and the component own
        asked = got["component"]["owners"].select("symbol_id").unionByName(self.spark.createDataFrame([(pick.component_id,), (call.symbol_id,)], "symbol_id string"))
        shown = contexts.symbols_with_ids(self.tables())
        on_path = [n for w in ways[:1] for n in w["path"]]
        shown = shown.join(asked.distinct().withColumn("_asked", F.lit(True)), "symbol_id", "left").where(F.col("_asked") | F.col("name").isin(on_path)).drop("_asked")
        names = {r.symbol_id: r for r in shown.collect()}
        comp, caller = names[pick.component_id], names[call.symbol_id]
        files = {s.name: s.file for s in names.values()}
        own = {names[r.symbol_id].name: names[r.symbol_id].file for r in got["component"]["owners"].collect()}
        diagram = render.trace_diagram({"name": comp.name, "file": comp.file}, files | own, ways[0] if ways else None, {"file": caller.file, "name": caller.name}, after, server)
        chain = [r.label for r in got["endpoint"]["chain"].where("phase <> 'error'").orderBy("position").collect()]
        text = render.trigger_text(ways[0]) if ways else "none found"
        link = render.link_text(pick.pinned, pick.match, pick.confidence)
        return diagram, render.trace_notes(comp.name, method, path, text, f"{call.method} {call.url_pattern}", link, chain, after, [n.removeprefix("Warning: ") for n in notes if n.startswith("Warning: ")])
