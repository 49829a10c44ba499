"""Repository configuration: discovery, validation, defaults, and pinned links."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

FOLDER, NAME = ".walkthrough", "config.json"
# Where backends and frontends usually live.
BACKENDS = ["apps/api", "apps/server", "apps/backend", "api", "server", "backend"]
FRONTENDS = ["apps/web", "apps/client", "apps/frontend", "web", "client", "frontend"]
TOKENS = 60_000


class ConfigError(ValueError):
    """A configuration that is missing or malformed."""


@dataclass
class Pin:
    """A call that the user ties to a route."""

    caller: str
    method: str
    url: str
    route: str

    def describe(self) -> str:
        return f"{self.caller} {self.method} {self.url} → {self.route}"


@dataclass
class Config:
    backend: str | None = None
    frontend: str | None = None
    ignore: list[str] = field(default_factory=list)
    wrappers: list[dict] = field(default_factory=list)
    pins: list[Pin] = field(default_factory=list)
    database: str = "wl_repo"
    max_context_tokens: int = TOKENS

    def roots(self) -> list[str]:
        return [r for r in (self.backend, self.frontend) if r]


def find_root(start: Path) -> Path | None:
    """The nearest directory at or above ``start`` that has a configuration."""
    return next((d for d in (start.resolve(), *start.resolve().parents) if (d / FOLDER / NAME).exists()), None)


def default(root: Path) -> Config:
    """Roots by common layouts; without any, the repository itself is the backend."""
    first = lambda names: next((n for n in names if (root / n).is_dir()), None)
    backend, frontend = first(BACKENDS), first(FRONTENDS)
    slug = re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", root.resolve().name.lower())) or "repo"
    return Config(backend=backend if backend or frontend else ".", frontend=frontend, database=f"wl_{slug}"[:63])


def load(root: Path) -> Config:
    path = root / FOLDER / NAME
    try:
        raw = json.loads(path.read_text())
    except FileNotFoundError:
        raise ConfigError(f"{path} does not exist") from None
    except json.JSONDecodeError as error:
        raise ConfigError(f"{path} is not JSON: {error}") from None
    if not isinstance(raw, dict):
        raise ConfigError(f"{path} must hold an object")
    roots = raw.get("roots", {})
    config = default(root)
    config.backend, config.frontend = roots.get("backend"), roots.get("frontend")
    if not config.roots():
        raise ConfigError("roots must name a backend or a frontend")
    for name in config.roots():
        if not (root / name).is_dir():
            raise ConfigError(f"root {name} is not a directory")
    config.ignore, config.wrappers = list(raw.get("ignore", [])), list(raw.get("apiClientWrappers", []))
    try:
        config.pins = [Pin(**p) for p in raw.get("pinnedEdges", [])]
    except TypeError as error:
        raise ConfigError(f"pinnedEdges: {error}") from None
    config.database = raw.get("database", {}).get("schema", config.database)
    if not re.fullmatch(r"[a-z_][a-z0-9_]{0,62}", config.database):
        raise ConfigError(f"{config.database!r} cannot name a database")
    config.max_context_tokens = int(raw.get("llm", {}).get("maxContextTokens", TOKENS))
    return config


def add_pin(root: Path, pin: Pin) -> None:
    """Write a pin in place of one of the same call; everything else in the file stays."""
    path = root / FOLDER / NAME
    raw = json.loads(path.read_text())
    same = lambda p: (p["caller"], p["method"], p["url"]) == (pin.caller, pin.method, pin.url)
    raw["pinnedEdges"] = [p for p in raw.get("pinnedEdges", []) if not same(p)] + [asdict(pin)]
    path.write_text(json.dumps(raw, indent=2) + "\n")
