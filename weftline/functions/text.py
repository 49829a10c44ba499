"""Column expressions over source lines, identifiers, digests and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that code spans may use without anything declaring them.
LANGUAGE_WORDS = (
    "true false null undefined NaN Infinity this super await async return throw new typeof instanceof in of void delete const let var function class "
    "if else try catch finally for while switch case break continue import export default from as type interface"
).split()

BLOCK_OVERHEAD = 10
RESERVED_TOKENS = 3000


def split_lines(text: Column | str) -> Column:
    """Lines without terminators; one empty line at the end is dropped."""
    text = F.col(text) if isinstance(text, str) else text
    # the last terminator goes first, so that the text is split once, and at a plain character, which needs no pattern
    cut = F.when(F.endswith(text, F.lit("\r\n")), F.left(text, F.length(text) - 2)).when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.split(F.when(F.contains(cut, F.lit("\r")), F.replace(cut, F.lit("\r\n"), F.lit("\n"))).otherwise(cut), "\n", -1)


def block_lines(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive), as far as the file goes."""
    n = F.greatest(F.least(end, F.size(lines)) - start + 1, F.lit(0))
    return F.slice(lines, start, n)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(utf16_length(text) / 4)


def block_cost(text: Column) -> Column:
    return estimate_tokens(text) + BLOCK_OVERHEAD


def hash_lines(lines: Column) -> Column:
    """SHA-256 of the lines alone, wherever they stand."""
    return F.sha2(F.array_join(lines, "\n").cast("binary"), 256)


def digest(keys: Column) -> Column:
    """SHA-256 of an ordered array of keys."""
    return F.sha2(F.array_join(keys, "\n").cast("binary"), 256)


def code_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))


def identifiers(code: Column) -> Column:
    """All identifiers; backslash escapes are blanked first."""
    return F.regexp_extract_all(F.regexp_replace(code, r"\\.", " "), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), F.lit(0))


def span_identifiers(text: Column) -> Column:
    """Distinct identifiers of a text's code spans."""
    return F.array_distinct(F.flatten(F.transform(code_spans(text), identifiers)))


def one_line(text: Column, most: int = 80) -> Column:
    """White space collapsed; longer than ``most`` ends in an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def error_status(detail: Column) -> Column:
    """The HTTP status that an error's description ends in."""
    return F.regexp_extract(detail, r"\s*\((\d{3})\)$", 1).try_cast("int")


def error_name(detail: Column) -> Column:
    return F.regexp_replace(detail, r"\s*\((\d{3})\)$", "")


def list_names(names: Column) -> Column:
    """ "a", "a and b", "a, b and c"."""
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))), ", ")
    return F.when(F.size(names) < 2, F.array_join(names, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(names, -1)))


def backticked(names: Column) -> Column:
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")


def dropped_note(dropped: Column) -> Column:
    """The note on references that reuse has dropped; null without any."""
    n = F.size(dropped)
    one = n == 1
    return F.when(
        n > 0,
        F.concat(n.cast("string"), F.when(one, " reference dropped because the code it pointed to changed: ").otherwise(" references dropped because the code they pointed to changed: "), F.array_join(dropped, ", ")),
    )


def locale_order(column: Column) -> list[Column]:
    """Sort keys for the order of the Unicode collation's root locale; equal ones by code points."""
    return [F.collate(column, "UNICODE"), column]


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)
