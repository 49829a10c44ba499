"""HTTP routes: stitching registrations into full routes, and matching requests and calls against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import METHODS, effective_path, has_prefix, join_path, segment_matches, segments
from ..functions.text import locale_order
from .graph import settle

# How much a kind of match is trusted, and from where on a unique best match is followed.
CONFIDENCE = {"exact": 1.0, "param": 0.9, "suffix": 0.6, "wildcard": 0.6, "method": 0.5}
ANY_METHOD_PENALTY = 0.05
RESOLVED_FROM = 0.9


def _is_param(segment: Column) -> Column:
    return F.startswith(segment, F.lit(":"))


def compare_segments(route: Column, call: Column) -> Column:
    """"exact", "param" or "wildcard" for two arrays of equal length, null if they do not fit.

    A route's parameter or "*" takes any literal, a call's parameter only those.
    Without a shared literal, or with a "*", the match is a wildcard.
    """
    pair = F.zip_with(
        route,
        call,
        lambda r, c: F.when((_is_param(r) | (r == "*")) & _is_param(c), "both").when(_is_param(r) | (r == "*"), "param").when(~_is_param(c) & (r == c), "literal").otherwise("none"),
    )
    has = lambda kind: F.array_contains(pair, kind)
    return (
        F.when(has("none"), F.lit(None).cast("string"))
        .when(F.array_contains(route, "*") | (has("param") & ~has("literal")), "wildcard")
        .when(has("param"), "param")
        .otherwise("exact")
    )


def match_kind(route: Column, call: Column) -> Column:
    """How a call's segments fit a route's: as a whole, or as its end with a shared literal ("suffix")."""
    n_route, n_call = F.size(route), F.size(call)
    tail = compare_segments(F.slice(route, F.greatest(n_route - n_call + 1, F.lit(1)), n_call), call)
    return F.when(n_route == n_call, compare_segments(route, call)).when((n_call > 0) & (n_route > n_call) & tail.isin("exact", "param"), "suffix")


def _open(segment: Column) -> Column:
    return _is_param(segment) | (segment == "*")


def _key(from_last: Column, form: Column) -> Column:
    """The segments as one text, those that the form leaves open as nothing."""
    return F.array_join(F.zip_with(from_last, form, lambda s, o: F.concat(F.lit("/"), F.when(o, "").otherwise(s))), "")


def route_keys(routes: DataFrame, suffixes: bool = True) -> DataFrame:
    """(route_id, route_method, full_path, have, n, form, key): what calls that fit a route ask for.

    A route stands under its last n segments for each n ("suffixes"; only where
    they have a literal and no "*") or all n. A form says which of them, from the
    last, are open; the key has the others.
    """
    r = routes.where("full_path is not null").select("route_id", F.col("method").alias("route_method"), "full_path", segments(F.col("full_path")).alias("have"))
    size = F.size("have")
    r = r.withColumn("n", F.explode(F.sequence(F.least(size, F.lit(1)) if suffixes else size, size)))
    tail = F.slice(F.reverse("have"), F.lit(1), F.col("n"))
    form = F.transform(tail, _open)
    r = r.where((F.col("n") == size) | (F.exists(form, lambda o: ~o) & ~F.array_contains(tail, "*")))
    return r.withColumns({"form": form, "key": _key(tail, form)})


def _asking(asked: DataFrame, keys: DataFrame, concrete: bool) -> DataFrame:
    """``asked`` (with _want, its segments) once for each form of its length that any route has, with the key it asks for then.

    There are as many forms as ways to mix open segments and literals, however
    many routes share them. Parameters of a call fit open segments alone; a
    ``concrete`` request has none.
    """
    forms = keys.select(F.col("n").alias("_n"), F.col("form").alias("_form")).distinct()
    c = asked.withColumns({"_n": F.size("_want"), "_last": F.reverse("_want")}).join(forms, "_n")
    if not concrete:
        c = c.where(F.forall(F.zip_with("_form", "_last", lambda o, s: o | ~_is_param(s)), lambda ok: ok))
    return c.withColumn("_key", _key(F.col("_last"), F.col("_form"))).drop("_n", "_last", "_form")


def candidates(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """(call_id, route_id, match, confidence, full_path, route_method): every route that a call could reach.

    ``calls`` has call_id, method, url_pattern; ``routes`` route_id, method, full_path.
    A call asks for its method and ALL (an UNKNOWN one for every method there
    is), with a key for each form of route; key and method are equal only for
    pairs that match, so a join key is as frequent as its results.
    """
    keys = route_keys(routes)
    c = calls.where("url_pattern is not null").select("call_id", "method", segments(F.col("url_pattern")).alias("_want"))
    c = _asking(c, keys, concrete=False)
    own = F.array_distinct(F.array("method", F.lit("ALL")))
    asked = c.withColumn("_ask", F.explode(F.when(F.col("method") == "UNKNOWN", F.array(*map(F.lit, METHODS))).otherwise(own)))
    pairs = asked.join(keys, (asked["_key"] == keys["key"]) & (asked["_ask"] == keys["route_method"])).withColumn("match", match_kind(F.col("have"), F.col("_want"))).where("match is not null")
    base = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("match")]
    unknown_method = F.col("method") == "UNKNOWN"
    confidence = F.when(unknown_method, F.least(base, F.lit(CONFIDENCE["method"]))).when(F.col("route_method") == "ALL", F.round(base - ANY_METHOD_PENALTY, 2)).otherwise(base)
    return pairs.select("call_id", "route_id", F.when(unknown_method, "method").otherwise(F.col("match")).alias("match"), confidence.alias("confidence"), "full_path", "route_method")


def best_first() -> list:
    return [F.desc("confidence"), "full_path", "route_method", "route_id"]


def cross_edges(calls: DataFrame, routes: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """(call_id, route_id, match, confidence, pinned, resolved): all candidate edges, the pinned or confident unique best resolved.

    ``pins`` has caller ("file#symbol"), method, url, route ("METHOD /path") and
    position; ``calls`` then has caller too. The first pin of a call counts, and
    none whose route is gone; a pinned route need not be a candidate.
    """
    found = candidates(calls, routes)
    w = W.partitionBy("call_id").orderBy(*best_first())
    ranked = found.withColumns({"_nth": F.row_number().over(w), "_next": F.lead("confidence").over(w)})
    best = (F.col("_nth") == 1) & (F.col("confidence") >= RESOLVED_FROM) & (F.col("_next").isNull() | (F.col("_next") < F.col("confidence")))
    edges = ranked.select("call_id", "route_id", "match", "confidence", F.lit(False).alias("pinned"), best.alias("resolved"))
    if pins is None:
        return edges
    at = calls.join(pins.select("caller", "method", F.col("url").alias("url_pattern"), "route", "position"), ["caller", "method", "url_pattern"])
    first = at.groupBy("call_id").agg(F.min_by("route", "position").alias("route"))
    target = routes.groupBy(F.concat_ws(" ", "method", "full_path").alias("route")).agg(F.min("route_id").alias("_pinned"))
    pinned = first.join(target, "route").select("call_id", "_pinned")
    rest = edges.join(pinned, "call_id", "left").where("_pinned is null or _pinned <> route_id")
    rest = rest.withColumn("resolved", F.col("resolved") & F.col("_pinned").isNull()).drop("_pinned")
    own = pinned.select("call_id", F.col("_pinned").alias("route_id"), F.lit("pinned").alias("match"), F.lit(1.0).alias("confidence"), F.lit(True).alias("pinned"), F.lit(True).alias("resolved"))
    return rest.unionByName(own)


def pin_warnings(calls: DataFrame, routes: DataFrame, pins: DataFrame) -> DataFrame:
    """(position, message) for pins without their call, or else without their route."""
    shown = F.concat(F.concat_ws(" ", "caller", "method", "url"), F.lit(" → "), F.col("route"))
    no_call = pins.join(calls.select("caller", "method", F.col("url_pattern").alias("url")).distinct(), ["caller", "method", "url"], "left_anti")
    has_call = pins.join(no_call.select("position"), "position", "left_anti")
    no_route = has_call.join(routes.select(F.concat_ws(" ", "method", "full_path").alias("route")).distinct(), "route", "left_anti")
    text = lambda df, why: df.select("position", F.concat(F.lit("Pinned edge "), shown, F.lit(why)).alias("message"))
    return text(no_call, ": no such API call in the index; remove it from pinnedEdges.").unionByName(text(no_route, ": no such route; the pin is ignored."))


def match_requests(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request_id, route_id, tier): the routes of concrete requests; equal paths before patterns, in each the method before ALL.

    ``requests`` has request_id, method, path; ``routes`` route_id, method,
    full_path. They are joined by method and key, as in ``candidates``.
    """
    keys = route_keys(routes, suffixes=False).select("route_id", F.col("route_method").alias("_m"), "full_path", "n", "form", F.col("key").alias("_key"))
    q = _asking(requests.select("request_id", "method", "path", segments(F.col("path")).alias("_want")).where("path is not null"), keys, concrete=True)
    joined = q.withColumn("_m", F.explode(F.array_distinct(F.array("method", F.lit("ALL"))))).join(keys, ["_key", "_m"])
    tier = F.when(F.col("full_path") == F.col("path"), 0).otherwise(2) + F.when(F.col("_m") == F.col("method"), 0).otherwise(1)
    found = joined.select("request_id", "route_id", tier.alias("tier"))
    least = found.groupBy("request_id").agg(F.min("tier").alias("tier"))
    return found.join(least, ["request_id", "tier"]).select("request_id", "route_id", "tier")


def similarity(path: Column, method: Column, full_path: Column, route_method: Column) -> Column:
    """Segments that fit by position, and half a point for the method."""
    want, have = segments(path), segments(full_path)
    fits = F.zip_with(want, have, lambda w, h: F.coalesce(w.isNotNull() & segment_matches(h, w), F.lit(False)))
    return F.size(F.filter(fits, lambda ok: ok)) + F.when((route_method == method) | (route_method == "ALL"), 0.5).otherwise(0.0)


def closest_routes(requests: DataFrame, routes: DataFrame, n: int = 5) -> DataFrame:
    """(request_id, position, route_id, score): for each request the ``n`` most similar routes with a score.

    Ties go by path, then route_id. Routes that share a segment by position come
    from a join on position and segment; of those that share only the method no
    more than the first ``n`` by path can get in, and these are joined by method.
    """
    r = routes.select("route_id", F.col("method").alias("route_method"), "full_path")
    opened = lambda s: F.when(_is_param(s) | (s == "*"), F.lit(":")).otherwise(s)
    have = r.select("route_id", F.posexplode(F.transform(segments(F.col("full_path")), opened)).alias("_i", "_key"))
    want = requests.select("request_id", F.posexplode(segments(F.col("path"))).alias("_i", "_s"))
    want = want.select("request_id", "_i", F.explode(F.array_distinct(F.array("_s", F.lit(":")))).alias("_key"))
    sharing = want.join(have, ["_i", "_key"]).select("request_id", "route_id")
    nth = F.row_number().over(W.partitionBy("route_method").orderBy("full_path", "route_id"))
    leading = r.withColumn("_nth", nth).where(F.col("_nth") <= n).select("route_id", F.col("route_method").alias("_m"))
    asked = requests.select("request_id", F.explode(F.array_distinct(F.array("method", F.lit("ALL")))).alias("_m"))
    pairs = sharing.unionByName(asked.join(leading, "_m").select("request_id", "route_id")).distinct()
    scored = pairs.join(requests.select("request_id", "method", "path"), "request_id").join(r, "route_id")
    scored = scored.withColumn("score", similarity(F.col("path"), F.col("method"), F.col("full_path"), F.col("route_method"))).where("score > 0")
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "full_path", "route_id"))
    return scored.withColumn("position", place).where(F.col("position") <= n).select("request_id", "position", "route_id", "score")


# --- stitching -------------------------------------------------------------------------------------


def _is_error(h: Column) -> Column:
    return F.coalesce(h["arity"] == 4, F.lit(False))


def handler_key(h: Column) -> Column:
    """The symbol that a handler runs: its own, or the one its factory returns; null for packages and unknown values."""
    return F.when(h["kind"].isin("symbol", "inline"), h["key"]).when(h["kind"] == "factory", F.coalesce(h["key"], h["factory"]))


def handler_label(h: Column) -> Column:
    return F.when(h["kind"].isin("symbol", "inline", "factory"), F.coalesce(h["key"]["name"], h["text"])).otherwise(h["text"])


def handler_note(h: Column, file: Column, line: Column) -> Column:
    return F.when(h["kind"] == "unresolved", F.concat(F.lit("unresolved: likely "), h["text"], F.lit(" (middleware registered at "), file, F.lit(":"), line.cast("string"), F.lit(")")))


def _at() -> Column:
    return F.concat_ws(":", F.col("file"), F.col("line").cast("string"))


def mount_edges(calls: DataFrame) -> DataFrame:
    """(src, dst): receivers and what they mount."""
    uses = calls.where("receiver_key is not null and call_kind = 'use'").select(F.col("receiver_key").alias("src"), F.explode("handlers").alias("h"))
    return uses.where("h.kind = 'router' and h.receiver_key is not null").select("src", F.col("h.receiver_key").alias("dst")).distinct()


def loose_key(file: Column) -> Column:
    """The key of warnings about a file's registrations that have no receiver."""
    return F.concat(F.lit("file:"), file)


def mounts(calls: DataFrame) -> DataFrame:
    """(key, prefix, chain, seen, places, app): every way to reach a receiver from an app that nothing mounts.

    ``chain`` has the mounts (file, line, end_line, prefix) from outside in,
    ``places`` for each level the receiver, its prefix and where in it the walk
    went on. A receiver is not entered again inside itself.
    """
    rows = _positioned(calls)
    kinds = rows.groupBy("key").agg(F.max_by("kind", F.col("seq")).alias("kind"))
    steps = _mount_steps(rows)
    roots = kinds.where("kind = 'app'").join(steps.select(F.col("target").alias("key")).distinct(), "key", "left_anti").select("key")
    level = "struct<key:string,prefix:string,pos:int,handler:int,order_idx:int>"
    mount = "struct<file:string,line:int,end_line:int,prefix:string>"
    now = roots.select("key", F.lit("/").alias("prefix"), F.array().cast(f"array<{mount}>").alias("chain"), F.array("key").alias("seen"), F.array().cast(f"array<{level}>").alias("places"), F.lit(0).alias("depth"))
    steps, now = settle(steps), settle(now)
    out, depth = now, 0
    while not now.isEmpty():
        depth += 1
        joined = now.join(steps, "key").where(~F.array_contains("seen", F.col("target")))
        place = F.struct("key", "prefix", F.col("pos").cast("int").alias("pos"), F.col("handler").cast("int").alias("handler"), F.col("order_idx").cast("int").alias("order_idx"))
        now = settle(joined.select(
            F.col("target").alias("key"),
            join_path(F.col("prefix"), F.col("path")).alias("prefix"),
            F.concat("chain", F.array(F.struct("file", F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"), F.col("path").alias("prefix")))).alias("chain"),
            F.concat("seen", F.array("target")).alias("seen"),
            F.concat("places", F.array(place)).alias("places"),
            F.lit(depth).alias("depth"),
        ))
        out = out.unionByName(now)
    return out


def _positioned(calls: DataFrame) -> DataFrame:
    """Placeable registrations with their position in their receiver, and effective path."""
    placed = calls.where("receiver_key is not null").withColumns({"key": F.col("receiver_key"), "kind": F.col("receiver_kind"), "path_": effective_path(F.col("path"), F.col("path_text"))})
    pos = F.row_number().over(W.partitionBy("key").orderBy(*locale_order(F.col("file")), "order_idx", "seq"))
    return placed.withColumn("pos", pos)


def _mount_steps(rows: DataFrame) -> DataFrame:
    exploded = rows.where("call_kind = 'use'").select("key", "pos", "order_idx", "file", "line", "end_line", F.col("path_").alias("path"), F.posexplode("handlers").alias("handler", "h"))
    return exploded.where("h.kind = 'router'").select("key", "pos", "order_idx", "file", "line", "end_line", "path", "handler", F.col("h.receiver_key").alias("target"), F.col("h.text").alias("text"))


def stitch(calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Full routes, their middleware and warnings, from registrations.

    ``calls`` has seq (order of the facts), file, receiver_key, receiver_kind,
    receiver_text, call_kind, method, path, path_text, line, end_line, order_idx
    and handlers. Returns

    * routes (route, method, full_path, file, line, end_line, handler, mount_chain, warnings, receivers: all on the way to it),
    * middleware (route, order_idx, phase, handler, file, line, end_line) in the order it runs:
      what apps and routers registered before the route and whose scope covers it, outer ones first;
      the route's own; then error handlers registered later, inner ones first,
    * warnings (key, message): registrations that could not be placed, by receiver or file.

    ``route`` is one registration in one way of reaching it.
    """
    rows = _positioned(calls)
    walked = mounts(calls)
    kinds = rows.groupBy("key").agg(F.max_by("kind", F.col("seq")).alias("kind_"))
    own = F.filter("handlers", lambda h: h["kind"] != "router")
    placed = rows.where("call_kind = 'route'").withColumn("own", own).where("size(own) > 0").join(walked, "key")
    full = join_path(F.col("prefix"), F.col("path_"))
    route_id = F.sha2(F.concat_ws("|", F.to_json(F.struct("places")), "key", F.col("pos").cast("string")).cast("binary"), 256)
    placed = placed.withColumns({"full_path": full, "route": route_id})
    dynamic = F.col("path").isNull() & F.col("path_text").isNotNull()
    note = F.concat(_at(), F.lit(": path `"), F.col("path_text"), F.lit("` is not a string literal; shown as *"))
    routes = placed.select(
        "route", F.coalesce("method", F.lit("ALL")).alias("method"), "full_path", "file", "line", "end_line", F.element_at("own", -1).alias("handler"), F.col("chain").alias("mount_chain"),
        F.when(dynamic, F.array(note)).otherwise(F.array().cast("array<string>")).alias("warnings"), F.col("seen").alias("receivers"),
    )
    # the levels around a route: each receiver on the way, and the route's own as the innermost
    inner = F.array(F.struct("key", "prefix", F.col("pos").cast("int").alias("pos"), F.lit(-1).alias("handler"), F.col("order_idx").cast("int").alias("order_idx")))
    levels = placed.select("route", "full_path", F.posexplode(F.concat("places", inner)).alias("level", "at"))
    levels = levels.select("route", "full_path", "level", F.col("at.key").alias("key"), F.col("at.prefix").alias("prefix"), F.col("at.pos").alias("at_pos"), F.col("at.handler").alias("at_handler"), F.col("at.order_idx").alias("at_order"))
    uses = rows.where("call_kind = 'use'").join(kinds, "key").select("key", "pos", "order_idx", "path_", "file", "line", "end_line", "kind_", F.posexplode("handlers").alias("nth", "handler"))
    around = levels.join(uses, "key").where(has_prefix(F.col("full_path"), join_path(F.col("prefix"), F.col("path_"))))
    before = (F.col("pos") < F.col("at_pos")) | ((F.col("pos") == F.col("at_pos")) & (F.col("nth") < F.col("at_handler")))
    phase = F.when(F.col("kind_") == "app", "app").otherwise("router")
    plain = around.where((F.col("handler.kind") != "router") & ~_is_error(F.col("handler")) & before)
    errors = around.where(_is_error(F.col("handler")) & (F.col("order_idx") > F.col("at_order")))
    columns = ["route", "phase", "handler", "file", "line", "end_line"]
    sort = lambda part, level: F.struct(F.lit(part).alias("part"), level.cast("int").alias("level"), F.col("pos").cast("int").alias("pos"), F.col("nth").cast("int").alias("nth"))
    at_route = placed.select("route", "pos", "file", "line", "end_line", F.posexplode(F.slice("own", F.lit(1), F.size("own") - 1)).alias("nth", "handler"))
    every = (
        plain.withColumns({"phase": phase, "_sort": sort(0, F.col("level"))}).select(*columns, "_sort")
        .unionByName(at_route.withColumns({"phase": F.lit("route"), "_sort": sort(1, F.lit(0))}).select(*columns, "_sort"))
        .unionByName(errors.withColumns({"phase": F.lit("error"), "_sort": sort(2, -F.col("level"))}).select(*columns, "_sort"))
    )
    order = F.row_number().over(W.partitionBy("route").orderBy("_sort")) - 1
    middleware = every.withColumn("order_idx", order).select("route", "order_idx", "phase", "handler", "file", "line", "end_line")
    return routes, middleware, _stitch_warnings(calls, rows, walked)


def _stitch_warnings(calls: DataFrame, rows: DataFrame, walked: DataFrame) -> DataFrame:
    verb = F.lower(F.coalesce("method", F.lit("use")))
    placeless = calls.where("receiver_key is null").select(
        loose_key(F.col("file")).alias("key"), F.concat(_at(), F.lit(": `"), F.col("receiver_text"), F.lit("."), verb, F.lit("(...)` registers on a value that isn't an app or router created in this repo with express() or Router(), so it can't be placed in the route tree")).alias("message")
    )
    dynamic = rows.where("call_kind = 'use' and path is null and path_text is not null").join(walked.select("key"), "key")
    dynamic = dynamic.select("key", F.concat(_at(), F.lit(": mount path `"), F.col("path_text"), F.lit("` is not a string literal; shown as *")).alias("message"))
    loops = _mount_steps(rows).join(walked.select("key", "seen"), "key").where(F.array_contains("seen", F.col("target")))
    loops = loops.select("key", F.concat(_at(), F.lit(": `"), F.col("text"), F.lit("` is already mounted above this router; skipped to avoid a loop")).alias("message"))
    lost = rows.where("call_kind = 'route'").select("key").distinct().join(walked.select("key").distinct(), "key", "left_anti")
    name = F.regexp_extract("key", "([^#]*)$", 1)
    lost = lost.select("key", F.concat(F.regexp_replace("key", "#[^#]*$", ""), F.lit(": router `"), name, F.lit("` has routes but is never mounted on an app")).alias("message"))
    return placeless.unionByName(dynamic).unionByName(loops).unionByName(lost)
