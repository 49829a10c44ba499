"""Tables that SQL statements read and write, as a vectorized function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The spelling of names and of transaction control.
NAME = r'"?[A-Za-z_][\w$]*"?(?:\."?[A-Za-z_][\w$]*"?)?'
TRANSACTION = re.compile(r"^\s*(BEGIN|COMMIT|ROLLBACK|SAVEPOINT|RELEASE|START\s+TRANSACTION|SET)\b", re.I | re.A)
NOT_TABLES = {"SET", "SELECT", "VALUES", "LATERAL", "ONLY", "DEFAULT"}

SCHEMA = "array<struct<kind:string,detail:string>>"
TOKEN = re.compile(rf"{NAME}|\S", re.A)
#: Words after which a table is named, the second where it takes two.
READS, WRITES = {"FROM", "JOIN"}, {"UPDATE": None, "INSERT": "INTO", "DELETE": "FROM"}
LOCKS = {"FOR", "KEY", "DO"}
QUERIES = {"SELECT", "WITH", "VALUES"}


def _named_queries(tokens: list[str]) -> set[str]:
    """Common table expressions: after WITH or a comma a name, AS, and a bracket, before which only [NOT] MATERIALIZED may stand."""
    out = set()
    for at, token in enumerate(tokens[:-2]):
        if token != "," and token.upper() != "WITH":
            continue
        if token != "," and tokens[at + 1].upper() == "RECURSIVE" and tokens[at + 2].upper() != "AS":
            at += 1
        name, (as_, *between) = tokens[at + 1], [t.upper() for t in tokens[at + 2 : at + 6]] or [""]
        opened = "(" in between and set(between[: between.index("(")]) <= {"NOT", "MATERIALIZED"}
        if as_ == "AS" and opened and re.match('"?[A-Za-z_]', name) and "." not in name:
            out.add(name.strip('"').lower())
    return out


def effects(sql: str | None) -> list[dict[str, str]]:
    """Distinct (kind, detail) in order of first mention; transaction control, null and empty text have none.

    One pass over words, names and brackets with a stack of the open brackets:
    whether each holds a function's arguments, where FROM names no table.
    """
    if not sql or TRANSACTION.match(sql):
        return []
    tokens = ["", *TOKEN.findall(sql), "", ""]
    hidden = _named_queries(tokens)
    arguments: list[bool] = [False]
    found: dict[tuple[str, str], None] = {}
    at = 0
    while at + 3 < len(tokens):
        at += 1
        word, after = tokens[at].upper(), tokens[at + 1].upper()
        if word == "(":
            named = tokens[at - 1][-1:] == "_" or tokens[at - 1][-1:].isalpha()
            arguments.append(named and after not in QUERIES)
        elif word == ")" and len(arguments) > 1:
            arguments.pop()
        elif word in READS or (word in WRITES and WRITES[word] in (None, after)):
            locking = word == "UPDATE" and tokens[at - 1].upper() in LOCKS
            at += 2 if WRITES.get(word) else 1
            name = tokens[at].replace('"', "")
            if not re.match(r"[A-Za-z_]", name):
                at -= 1
                continue
            called = word in READS and (tokens[at + 1] == "(" or arguments[-1])
            if not (locking or called or name.upper() in NOT_TABLES or name.lower() in hidden):
                found[("db_read", f"SELECT {name}") if word in READS else ("db_write", f"{word} {name}")] = None
    return [{"kind": kind, "detail": detail} for kind, detail in found]


def sql_effects(sql: Column) -> Column:
    """array<struct<kind, detail>> of a column of SQL texts; parentheses need a stack, so this runs on Arrow batches."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(effects)

    return run(sql)
