"""Text from context rows: sequence diagrams, Markdown, overview notes. Runs on the driver, over one target's collected rows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from urllib.parse import urlsplit

#: The participant that each kind of side effect goes to.
STORES = {"db_read": "Postgres", "db_write": "Postgres", "redis": "Redis", "queue": "Events"}


def label(text: str) -> str:
    """A diagram label: without the characters that end a statement or start an entity."""
    return re.sub(r"[;#\n]", " ", text).strip()


def _basename(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _store(kind: str, detail: str) -> tuple[str, str]:
    if kind != "http_out":
        return f"store:{STORES[kind]}", STORES[kind]
    host = urlsplit((detail.split(" ") + [""])[1]).netloc or "HTTP"
    return f"http:{host}", host


class _Participants:
    def __init__(self, prefix: str) -> None:
        self.prefix, self.ids, self.lines = prefix, {}, []

    def get(self, key: str, text: str) -> str:
        if key not in self.ids:
            self.ids[key] = f"{self.prefix}{len(self.ids) + 1}"
            self.lines.append(f"  participant {self.ids[key]} as {label(text)}")
        return self.ids[key]


def endpoint_diagram(route: dict, chain: list[dict], callees: list[dict], effects: list[dict], error_paths: list[dict]) -> str:
    """The sequence diagram of one endpoint.

    ``route`` has method and full_path; ``chain`` label and symbol_id in order;
    ``callees`` caller_id, callee_id, call_line, name, file and kind of what is
    called; ``effects`` symbol_id, effect, detail, line; ``error_paths``
    symbol_id, line, error, status.
    """
    who, messages = _Participants("P"), []
    events: dict[str, list[tuple[int, int, str, dict]]] = defaultdict(list)
    for e in effects:
        events[e["symbol_id"]].append((e["line"], 0, "effect", e))
    for p in error_paths:
        if p["status"] is not None:
            events[p["symbol_id"]].append((p["line"], 1, "error", p))
    for c in callees:
        if c["callee_id"] and c["kind"] not in ("type", "class"):
            events[c["caller_id"]].append((c["call_line"], 2, "call", c))

    def visit(symbol: str, own: str, path: frozenset[str]) -> None:
        for _, _, what, e in sorted(events[symbol], key=lambda x: x[:2]):
            if what == "effect":
                messages.append(f"  {own}->>{who.get(*_store(e['effect'], e['detail']))}: {label(e['detail'])}")
            elif what == "error":
                messages.extend([f"  alt {label(e['error'])}", f"    {own}-->>Client: {e['status']}", "  end"])
            else:
                to = who.get(f"file:{e['file']}", _basename(e["file"]))
                messages.append(f"  {own}->>{to}: {label(e['name'])}()")
                if e["callee_id"] not in path:
                    visit(e["callee_id"], to, path | {e["callee_id"]})

    nodes = [who.get(f"node:{i}", n["label"]) for i, n in enumerate(chain)]
    for i, node in enumerate(chain):
        messages.append(f"  {nodes[i - 1] if i else 'Client'}->>{nodes[i]}: " + ("next()" if i else f"{route['method']} {route['full_path']}"))
        if node["symbol_id"]:
            visit(node["symbol_id"], nodes[i], frozenset([node["symbol_id"]]))
    messages.append(f"  {nodes[-1]}-->>Client: response")
    return "\n".join(["sequenceDiagram", "  participant Client", *who.lines, *messages])


def trace_diagram(component: dict, files: dict[str, str], trigger: dict | None, call: dict, after: list[str], server: str) -> str:
    """The diagram of a whole request: user or effect, component, frontend files on the way, then the endpoint's diagram.

    ``component`` has name and file, ``files`` the file of each function name,
    ``trigger`` kind, label and path, ``call`` file and name of the calling
    function, ``after`` what it calls after the response.
    """
    ids, lines = {component["file"]: "C"}, ["  actor User", f"  participant C as {label(component['name'])}"]

    def get(file: str) -> str:
        if file not in ids:
            ids[file] = f"F{len(ids)}"
            lines.append(f"  participant {ids[file]} as {label(_basename(file))}")
        return ids[file]

    if trigger is None:
        messages = ["  Note over C: no trigger found"]
    elif trigger["kind"] == "effect":
        messages = [f"  Note over C: {label(trigger['label'])}"]
    else:
        messages = [f"  User->>C: {label(trigger['label'])}"]
    at = "C"
    for name in trigger["path"] if trigger else [call["name"]]:
        to = get(files.get(name, call["file"]))
        messages.append(f"  {at}->>{to}: {label(name.rsplit('.', 1)[-1])}()")
        at = to
    for line in server.split("\n")[1:]:
        if line.strip() == "participant Client":
            continue
        if line.lstrip().startswith("participant "):
            lines.append(line)
        else:
            messages.append(re.sub(r"(-?->>)Client:", rf"\g<1>{at}:", re.sub(r"^(\s+)Client(?=-?->>)", rf"\g<1>{at}", line)))
    calls = list(dict.fromkeys(f"{a.rsplit('.', 1)[-1]}()" for a in after))
    if calls:
        messages.append(f"  Note over {at}: then {label(', '.join(calls))}")
    return "\n".join(["sequenceDiagram", *lines, *messages])


def numbered_code(file: str, start: int, end: int, lines: list[str]) -> str:
    width = len(str(end))
    body = [f"{start + i:>{width}} | {line}" for i, line in enumerate(lines[start - 1 : end])]
    return "\n".join(["```" + ("tsx" if file.endswith(".tsx") else "ts"), *body, "```"])


def _listed(title: str, rows: list[str]) -> list[str]:
    return ["", f"**{title}**", *(f"- {r}" for r in rows)] if rows else []


def step_text(step: dict) -> list[str]:
    """The body of a step: explanation, example, references, docs, concepts and risks."""
    example = step.get("example") or {}
    out = [step["explanation"], "", f"**Example:** {example.get('input', '')}  ", f"**After:** {example.get('state_after', '')}"]
    out += _listed("References", [f"{r['role']} `{r['file']}:{r['line']}`" for r in step.get("references") or []])
    out += _listed("Docs", [f"[{d['package']} {d['symbol']}]({d['url']})" for d in step.get("doc_links") or []])
    if step.get("concepts"):
        out += ["", f"**Concepts:** {' · '.join(step['concepts'])}"]
    return out + _listed("Risks", step.get("risks") or [])


def markdown(title: str, scope: str, walkthrough: dict, source: Callable[[str], list[str]], notes: list[str] = (), diagram: str | None = None, questions: dict[str, list[dict]] | None = None, dropped: list[dict] = ()) -> str:
    """A walkthrough as Markdown, with the current code of each step and the questions asked about it (by step id)."""
    out = [f"# {title}", "", f"`{scope}`", "", walkthrough.get("summary") or ""]
    if notes:
        out += ["", "## Overview", "", *(f"- {n}" for n in notes)]
    if diagram:
        out += ["", "## Sequence", "", "```mermaid", diagram, "```"]
    n = 0
    for stage in walkthrough["stages"]:
        out += ["", f"## {stage['name']}"]
        for step in stage["steps"]:
            n += 1
            ref = step["code_ref"]
            out += ["", f"### Step {n} · `{ref['file']}:{ref['start']}-{ref['end']}`", "", numbered_code(ref["file"], ref["start"], ref["end"], source(ref["file"])), "", *step_text(step)]
            asked = (questions or {}).get(step["id"], [])
            if asked:
                out += ["", "**Questions**"]
                for q in asked:
                    stale = " *(stale: asked about an earlier explanation)*" if q["outdated"] else ""
                    question, answer = (q[c].replace("\n", "\n  ") for c in ("question", "answer"))
                    out += [f"- **Q:** {question}{stale}", f"  **A:** {answer}", *(f"  ⚠ {w}" for w in q["warnings"])]
    out += ["", "## Verification", "", f"Verified: {n} step(s) kept, {len(dropped)} dropped.", *(f"- dropped {d['step_id']}: {'; '.join(d['reasons'])}" for d in dropped)]
    if walkthrough.get("unresolved"):
        out += ["", "## Unresolved", "", *(f"- {u}" for u in walkthrough["unresolved"])]
    return "\n".join(out) + "\n"


def file_notes(importers: list[dict], exports: list[dict], helpers: list[dict], order: list[str], cycles: list[str]) -> list[str]:
    names = lambda rows: ", ".join(f"{r['name']} ({r['kind']}, line {r['start_line']})" for r in rows) or "none"
    by = "; ".join(f"{i['importer']} ({', '.join(i['imported_names'])})" if i["imported_names"] else i["importer"] for i in importers)
    return [f"Imported by: {by or 'no indexed file'}", f"Exports: {names(exports)}", f"Internal helpers: {names(helpers)}", f"Walk order (helpers first): {' → '.join(order) or 'no functions'}", *(f"Cycle: {c}" for c in cycles)]


def endpoint_notes(route: dict, chain: list[dict], effects: list[dict], error_paths: list[dict], warnings: list[str] = ()) -> list[str]:
    mounts = " → ".join(f"{m['prefix']} ({m['file']}:{m['line']})" for m in route["mount_chain"]) or "directly on the app"
    runs = " → ".join(f"{n['label']} [{n['phase']}]" for n in chain if n["phase"] != "error")
    errors = ", ".join(f"{n['label']} ({n['file']}:{n['line']})" for n in chain if n["phase"] == "error") or "none (Express default)"
    out = [f"Route: {route['method']} {route['full_path']}", f"Mounted via: {mounts}", f"Middleware chain: {runs}", f"Error handlers: {errors}"]
    out += [f"Side effect: {e['effect']} {e['detail']} in {e['name']} ({e['file']}:{e['line']})" for e in effects]
    out += [f"Can fail: {p['error']}" + (f" → {p['status']}" if p["status"] is not None else "") + f" in {p['name']} ({p['file']}:{p['line']})" for p in error_paths]
    return [*out, *(f"Warning: {w}" for w in warnings)]


def trace_notes(component: str, method: str, path: str, trigger: str, call: str, link: str, chain: list[str], after: list[str], warnings: list[str] = ()) -> list[str]:
    return [
        f"Trace: {component} → {method} {path}", f"Trigger: {trigger}", f"API call: {call} — {link}", f"Server: {' → '.join(chain)}",
        f"After the response: {', '.join(after) or 'nothing in the calling function'}", *(f"Warning: {w}" for w in warnings),
    ]


def link_text(pinned: bool, match: str, confidence: float) -> str:
    return "pinned in the configuration" if pinned else f"{match} match, confidence {confidence:.1f}"


def trigger_text(trigger: dict) -> str:
    return f"{trigger['label']} ({trigger['place']}) → {' → '.join(trigger['path'])}"
