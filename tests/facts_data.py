"""Small hand-written facts: a service and a controller that calls it."""


def key(file, name, line):
    return {"file": file, "name": name, "start_line": line}


def symbol(name, start, end, exported=True, kind="function"):
    return {"name": name, "kind": kind, "start_line": start, "end_line": end, "exported": exported, "signature": f"function {name}()"}


def call(caller, line, text, callee=None, resolved=True):
    return {"caller": {"name": caller[0], "start_line": caller[1]}, "callee": callee, "callee_text": text, "line": line, "resolved": resolved}


SERVICE, CONTROLLER = "api/service.ts", "api/controller.ts"


def service(shift=0):
    at = 5 + shift
    return {
        "path": SERVICE, "hash": f"s{shift}", "language": "typescript",
        "symbols": [symbol("normalize", 1, 3), symbol("enroll", at, at + 7), symbol("ping", 14 + shift, 16 + shift, False), symbol("pong", 18 + shift, 20 + shift, False)],
        "calls": [
            call(("enroll", at), at + 1, "normalize", key(SERVICE, "normalize", 1)), call(("enroll", at), at + 3, "pool.query"), call(("enroll", at), at + 5, "handlers[name]", resolved=False),
            call(("ping", 14 + shift), 15 + shift, "pong", key(SERVICE, "pong", 18 + shift)), call(("pong", 18 + shift), 19 + shift, "ping", key(SERVICE, "ping", 14 + shift)),
        ],
        "imports": [{"imported_path": "pg", "resolved_path": None, "imported_names": ["Pool"], "package_name": "pg", "package_version": "8.12.0"}],
        "side_effects": [{"symbol": {"name": "enroll", "start_line": at}, "kind": "db_write", "detail": "INSERT patients", "line": at + 3}],
    }


def controller(enroll_at=5):
    return {
        "path": CONTROLLER, "hash": "c", "language": "typescript", "symbols": [symbol("handle", 3, 7)],
        "calls": [call(("handle", 3), 4, "enroll", key(SERVICE, "enroll", enroll_at))],
        "imports": [{"imported_path": "./service", "resolved_path": SERVICE, "imported_names": ["enroll"], "package_name": None, "package_version": None}],
    }


def frame(spark, *records):
    from weftline.sources.facts import FACTS

    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in FIELDS) for r in records], FACTS) if records else spark.createDataFrame([], FACTS)


FIELDS = ["path", "hash", "language", "symbols", "calls", "imports", "router_calls", "side_effects", "react_facts", "api_calls", "declarations", "text"]
