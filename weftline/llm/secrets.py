"""Secrets in text, with built-in column functions only.

Three kinds come from patterns: assignments, access keys and long hex runs. The
fourth, ``entropy``, comes from sliding windows: within every candidate (a run
of at least WINDOW characters of the base64 and URL alphabets) the Shannon
entropy of each window of WINDOW characters is kept by counts that change at
the window's two ends only. Pattern spans are cut out of a candidate, and each
remaining piece counts if some window in it that touches no match of the
allow-list reaches the threshold of its character class: that of the window, or
of the whole stretch between such matches if that is lower.

Positions are code points, ends exclusive. Matches are found by marking them
with U+0001 (a U+0001 of the text stands in as U+0002 meanwhile, which no
pattern contains) and splitting there; the running position over a row's
matches is then a fold. Only rows that match at all get that far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: character class -> (what a stretch of it looks like, least entropy of a window in bits)
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", 3.0),
    "alnum": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9]+$", 3.6),
    "base64": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.8),
}
#: The same for single windows of one kind of letter with digits, or of letters only: (least numbers of upper-case
#: letters, lower-case letters and digits, least entropy). No other symbols. The counts spare words of prose.
NARROW = {"lower": (0, 1, 2, 3.5), "upper": (1, 0, 1, 3.5), "letters": (4, 4, 0, 3.7)}
#: What is no secret: UUIDs, placeholders, counting sequences. (A character repeated eight times needs no pattern: a
#: window that holds it has 3.12 bits at most.)
ALLOWED = [
    r"(?<![0-9a-zA-Z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-zA-Z])",
    r"(?i:example|sample|dummy|placeholder|changeme|your[_-]?(?:api|key|token|secret))",
    r"(?i:0123456789|abcdefghij)",
]

_MARK = "\u0001"
_SPAN = "struct<kind:int,start:bigint,`end`:bigint>"


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


#: Elements that a fold goes over before what it has put out is laid aside.
FOLD_BLOCK = 64


def _folded(elements: Column, start: Column, step, out: str) -> Column:
    """What ``step`` puts out over ``elements``, from state ``start``, as one array.

    ``step`` gives the next state with an array ``out`` of what one element adds.
    Appending to one long array would copy it for every element, so each block's
    is gathered alone, and blocks' arrays are then strung together.
    """
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(elements), F.lit(1)), F.lit(FOLD_BLOCK)), lambda i: F.slice(elements, i, F.lit(FOLD_BLOCK)))

    def one(state: Column, element: Column) -> Column:
        return _let(step(state, element), lambda new: new.withField(out, F.concat(state[out], new[out])))

    def block(state: Column, own: Column) -> Column:
        fresh = state.withField(out, F.get(state[out], F.lit(0)))
        inner = F.aggregate(own, fresh.withField(out, F.slice(fresh[out], F.lit(1), F.lit(0))), one)
        return _let(inner, lambda new: new.withField(out, F.concat(state[out], F.array(new[out]))))

    return F.aggregate(blocks, start.withField(out, F.array(start[out])), block, lambda s: F.flatten(s[out]))


def _matches(text: Column, pattern: str, kind: int, keep=None, pieces=None) -> Column:
    """Spans of the leftmost non-overlapping matches whose text ``keep`` accepts, or of the ``pieces`` (of text and start) of each."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.char_length(part)
        if pieces:
            found = F.when(state["odd"], pieces(part, state["at"])).otherwise(_none())
        else:
            span = F.array(F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), end.alias("end")))
            found = F.when(state["odd"] & keep(part), span).otherwise(_none())
        return F.struct(end.alias("at"), (~state["odd"]).alias("odd"), found.alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("odd"), _none().alias("spans"))
    folded = _let(parts, lambda own: _folded(own, start, step, "spans"))
    return F.when(F.regexp_like(text, F.lit(pattern)), folded).otherwise(_none())


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _over_windows(candidate: Column, window: int, first: Column, seen_one, kinds: bool = False) -> Column:
    """Fold ``seen_one`` (of result, entropy in bits, kinds) over the candidate's windows, from ``first``.

    State: the count of each symbol in the window and the sum of count * log2(count);
    each step changes the counts of the symbol that leaves and of the one that enters.
    With ``kinds`` the numbers of its upper-case letters, lower-case letters, digits and
    symbols that are not hexadecimal are kept in the bytes of one number.
    """
    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    kind_of = F.array(F.lit(0), *(F.lit(c.isupper() + (c.islower() << 8) + (c.isdigit() << 16) + ((c not in "0123456789abcdefABCDEF") << 24)) for c in ALPHABET))

    def pairs(own: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), own)
        return F.zip_with(own, F.slice(leaving, F.lit(1), F.size(own)), lambda i, o: F.struct(i.alias("i"), o.alias("o")))

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def step(state: Column, pair: Column) -> Column:
        n_out = F.when(pair["o"] > 0, F.get(state["counts"], pair["o"] - 1)).otherwise(F.lit(0))
        n_in = F.get(state["counts"], pair["i"] - 1) - (pair["o"] == pair["i"]).cast("int")
        total = state["total"] - (term(n_out) - term(n_out - 1)) + (term(n_in + 1) - term(n_in))
        seen = state["seen"] + 1
        counts = F.transform(state["counts"], lambda c, k: c + (k + 1 == pair["i"]).cast("int") - (k + 1 == pair["o"]).cast("int"))
        has = state["kinds"] + F.get(kind_of, pair["i"]) - F.get(kind_of, pair["o"]) if kinds else state["kinds"]
        result = F.when(seen >= window, seen_one(state["result"], F.log2(F.lit(float(window))) - total / window, has)).otherwise(state["result"])
        return F.struct(counts.alias("counts"), total.alias("total"), seen.alias("seen"), has.alias("kinds"), result.alias("result"))

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("seen"), F.lit(0).alias("kinds"), first.alias("result"))
    return F.aggregate(_let(codes, pairs), start, step, lambda s: s["result"])


def window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of the candidate's windows (0 if it is shorter than one)."""
    return _over_windows(candidate, window, F.lit(0.0), lambda best, entropy, _: F.greatest(best, entropy))


def _high(stretch: Column) -> Column:
    """Whether some window of a stretch reaches the bar of its own class or of the stretch's."""
    own = F.when(F.lit(False), F.lit(99.0))
    for looks, least in CLASSES.values():
        own = own.when(F.regexp_like(stretch, F.lit(looks)), F.lit(least))

    def reaches(bar: Column):
        def seen_one(found: Column, entropy: Column, kinds: Column) -> Column:
            upper, lower, digits, not_hex = (F.shiftright(kinds, 8 * i).bitwiseAND(F.lit(255)) for i in range(4))
            plain = upper + lower + digits == WINDOW
            every = (upper > 0) & (lower > 0) & (digits > 0)
            high = (entropy >= bar) | (not_hex == 0) & (entropy >= CLASSES["hex"][1]) | every & (entropy >= F.when(plain, F.lit(CLASSES["alnum"][1])).otherwise(F.lit(CLASSES["base64"][1])))
            few = {"lower": upper == 0, "upper": lower == 0, "letters": digits == 0}
            for name, (least_upper, least_lower, least_digits, least) in NARROW.items():
                high = high | plain & few[name] & (upper >= least_upper) & (lower >= least_lower) & (digits >= least_digits) & (entropy >= least)
            return found | ((entropy >= CLASSES["hex"][1]) & high)

        return seen_one

    # words of one case, with other symbols or not, reach no bar
    mixed = F.regexp_like(stretch, F.lit("[0-9]|[a-z].*[A-Z]|[A-Z].*[a-z]"))
    return (F.char_length(stretch) >= WINDOW) & mixed & _let(F.coalesce(own, F.lit(99.0)), lambda bar: _over_windows(stretch, WINDOW, F.lit(False), reaches(bar), kinds=True))


def _entropy_spans(text: Column, base: Column) -> Column:
    """The pieces of candidates, between base spans, that have a window of high entropy clear of the allow-list."""
    allowed = F.lit("|".join(ALLOWED))

    def is_secret(piece: Column) -> Column:
        stretches = F.split(F.regexp_replace(piece, allowed, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
        return F.exists(F.filter(stretches, lambda _, i: i % 2 == 0), _high)

    def pieces(part: Column, at: Column) -> Column:
        end = at + F.char_length(part)
        inside = F.filter(base, lambda b: (b["start"] < end) & (at < b["end"]))
        ordered = F.array_sort(F.transform(inside, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))

        def span(start: Column, stop: Column) -> Column:
            return F.struct(F.lit(KINDS.index("entropy")).alias("kind"), start.alias("start"), stop.alias("end"))

        def step(state: Column, b: Column) -> Column:
            return F.struct(F.greatest(state["at"], b["end"]).alias("at"), F.concat(state["out"], F.array(span(state["at"], b["start"]))).alias("out"))

        gaps = F.aggregate(ordered, F.struct(at.alias("at"), _none().alias("out")), step, lambda s: F.concat(s["out"], F.array(span(s["at"], end))))
        piece = lambda g: F.substring(part, (g["start"] - at + 1).cast("int"), (g["end"] - g["start"]).cast("int"))
        return F.filter(gaps, lambda g: (g["end"] - g["start"] >= WINDOW) & is_secret(piece(g)))

    return _matches(text, CANDIDATE, KINDS.index("entropy"), pieces=pieces)


def spans(text: Column) -> Column:
    """All spans of a text (null: none) as array<struct<kind, start, end>>, by start, then kind as listed in KINDS."""
    text = F.translate(F.coalesce(text, F.lit("")), _MARK, "\u0002")
    long_value = lambda part: F.char_length(F.regexp_extract(part, ASSIGN, 2)) >= 6
    always = lambda part: F.lit(True)
    base = F.concat(_matches(text, ASSIGN, 0, long_value), _matches(text, ACCESS, 1, always), _matches(text, HEX, 2, always))
    every = _let(base, lambda own: F.concat(own, _entropy_spans(text, own)))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"])
    return F.array_sort(every, order)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column secret_spans, computed once a row."""
    return docs.withColumn("secret_spans", spans(F.col("text").cast("string")))


def described(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, label: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``label``."""

    def step(state: Column, span: Column) -> Column:
        new = span["start"] >= state["at"]
        gap = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(new, F.array(gap, F.lit(label))).otherwise(F.array().cast("array<string>")).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    last = F.array_max(F.transform(found, lambda s: s["end"]))
    whole = F.concat(F.array_join(_folded(found, start, step, "out"), ""), F.substring(text, (last + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) for each row of ``docs`` (doc_id, text, ...).

    A null or empty text has no spans: zero counts, the digest of the empty
    string and an empty ``spans``. Rows are independent, so repeated rows and
    null doc_ids are reported as they come. Other columns play no part.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = described(F.filter("secret_spans", lambda s: s["kind"] < KINDS.index("entropy")))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), described(F.col("secret_spans")).alias("spans"), count("entropy")
    )
