"""Column expressions over URL paths, file paths and module specifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP methods a request target may name, and modules that belong to the runtime itself.
METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ALL"]
RUNTIME_MODULES = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path "
    "perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib"
).split()


def normalize_path(path: Column) -> Column:
    """One leading slash, single slashes, none at the end unless the path is "/"."""
    single = F.regexp_replace(F.concat(F.lit("/"), path), "/+", "/")
    return F.when(F.length(single) > 1, F.regexp_replace(single, "/$", "")).otherwise(single)


def join_path(prefix: Column, path: Column) -> Column:
    return normalize_path(F.concat(prefix, F.lit("/"), path))


def segments(path: Column) -> Column:
    """The non-empty parts between slashes."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def has_prefix(path: Column, scope: Column) -> Column:
    """Whether ``scope`` covers ``path`` segment by segment."""
    return (scope == "/") | (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def url_pattern(url: Column) -> Column:
    """A URL without scheme, host, query and fragment; a rooted path is normalized."""
    local = F.regexp_replace(F.regexp_replace(url, r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    return F.when(F.startswith(local, F.lit("/")), normalize_path(local)).otherwise(local)


def template_pattern(parts: Column, params: Column) -> Column:
    """The pattern of a URL template: literal ``parts`` around substitutions named ``params``.

    A substitution before a first literal that starts with "/" is a base address and is dropped.
    """
    based = (F.size(params) > 0) & (F.coalesce(F.get(parts, F.lit(0)), F.lit("")) == "") & F.startswith(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit("/"))
    tail = F.transform(params, lambda p, i: F.when(based & (i == 0), F.get(parts, i + 1)).otherwise(F.concat(F.lit(":"), p, F.coalesce(F.get(parts, i + 1), F.lit("")))))
    return url_pattern(F.concat(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.array_join(tail, "")))


def effective_path(path: Column, path_text: Column) -> Column:
    """A registration's path: the literal, "*" if it is dynamic, "/" if it has none."""
    return F.coalesce(path, F.when(path_text.isNotNull(), F.lit("*")).otherwise(F.lit("/")))


def request_method(target: Column) -> Column:
    """The upper-cased method of "METHOD /path", null if there is none or it is unknown."""
    method = F.upper(F.regexp_extract(target, r"^\s*([A-Za-z]+)\s+(\S+)\s*$", 1))
    return F.when(method.isin(METHODS), method)


def request_path(target: Column) -> Column:
    """The normalized path of "METHOD /path" without query and fragment, null unless it is rooted."""
    raw = F.regexp_replace(F.regexp_extract(target, r"^\s*([A-Za-z]+)\s+(\S+)\s*$", 2), r"[?#].*$", "")
    return F.when(F.startswith(raw, F.lit("/")), normalize_path(raw))


def segment_matches(pattern: Column, value: Column) -> Column:
    return (pattern == "*") | (F.startswith(pattern, F.lit(":")) & (F.length(value) > 0)) | (pattern == value)


def path_matches(pattern: Column, path: Column) -> Column:
    """Whether a concrete path fits a pattern, segment by segment."""
    p, s = segments(pattern), segments(path)
    return (F.size(p) == F.size(s)) & F.forall(F.zip_with(p, s, lambda a, b: F.coalesce(segment_matches(a, b), F.lit(False))), lambda ok: ok)


def posix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_file(path: Column) -> Column:
    """Trimmed, with forward slashes, without a leading "./"."""
    return F.regexp_replace(posix_path(F.trim(path)), r"^\./", "")


def target_file(target: Column) -> Column:
    """The file of "<file>#<symbol>", "<file>:<start>-<end>" or "<file>"."""
    return normalize_file(F.regexp_replace(F.regexp_replace(target, r"#[^#]*$", ""), r":\d+-\d+$", ""))


def target_symbol(target: Column) -> Column:
    name = F.trim(F.regexp_extract(target, r"^.+#([^#]*)$", 1))
    return F.when(name != "", name)


def target_range(target: Column) -> Column:
    """struct(start, end) of "<file>:<start>-<end>", null if it is malformed or runs backwards."""
    start, end = (F.regexp_extract(target, r"^[^#]+:(\d+)-(\d+)$", g).try_cast("int") for g in (1, 2))
    return F.when((start >= 1) & (end >= start), F.struct(start.alias("start"), end.alias("end")))


def package_name(specifier: Column) -> Column:
    """The package of a module specifier; "node" for runtime modules, null for relative ones."""
    scoped = F.regexp_extract(specifier, r"^(@[^/]*(?:/[^/]*)?)", 1)
    first = F.substring_index(specifier, "/", 1)
    return (
        F.when(specifier.rlike(r"^[./]"), F.lit(None).cast("string"))
        .when(F.startswith(specifier, F.lit("node:")) | first.isin(RUNTIME_MODULES), F.lit("node"))
        .when(F.startswith(specifier, F.lit("@")), scoped)
        .otherwise(first)
    )


def redacted_url(url: Column) -> Column:
    """A URL with its password masked; everything else stays as it is written."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#:]*:)[^/?#]+@", "$1***@")


def module_name(specifier: Column) -> Column:
    bare = F.regexp_replace(specifier, "^node:", "")
    return F.when(F.startswith(bare, F.lit("@")), F.substring_index(bare, "/", 2)).otherwise(F.substring_index(bare, "/", 1))


def repository_slug(directory: Column) -> Column:
    """A database name for a repository directory."""
    base = F.lower(F.regexp_extract(F.regexp_replace(directory, "/+$", ""), r"([^/]*)$", 1))
    slug = F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(F.concat(F.lit("wl_"), F.when(slug == "", "repo").otherwise(slug)), 1, 63)


def document_slug(kind: Column, ref: Column) -> Column:
    """A readable file name that a digest keeps distinct."""
    readable = F.substring(F.regexp_replace(ref, "[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.concat_ws("--", kind, readable, F.substring(F.sha2(F.concat_ws(":", kind, ref).cast("binary"), 256), 1, 8))


def repository_url(repository: Column) -> Column:
    """A browsable address of a manifest's repository field, null if there is none."""
    short = F.regexp_extract(repository, r"^(?:github:)?([\w.-]+/[\w.-]+)$", 1)
    url = repository
    for pattern, new in ((r"^git\+", ""), (r"^git://", "https://"), (r"^ssh://git@", "https://"), (r"^git@([^:]+):", "https://$1/"), (r"\.git$", "")):
        url = F.regexp_replace(url, pattern, new)
    return F.when(short != "", F.concat(F.lit("https://github.com/"), short)).when(url.rlike("^https?://"), url)
