"""Where blocks of lines stand now: rolling fingerprints of all windows, looked up file by file, and an exact check.

A block's fingerprint is the sum of its lines' numbers and the sum of these
times their place in the block, both modulo a prime. With running sums over a
file the fingerprint of any window follows from two lines' sums, so a file is
read once, whatever the blocks' lengths. What fits goes by the exact digest.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.text import hash_lines  # noqa: F401

MODULUS = 2**31 - 1


def line_number(line: Column) -> Column:
    return F.pmod(F.xxhash64(line), F.lit(MODULUS))


def _print(plain: Column, placed: Column) -> Column:
    return F.pmod(plain, F.lit(MODULUS)) * F.lit(1 << 31) + F.pmod(placed, F.lit(MODULUS))


def block_print(lines: Column) -> Column:
    """The fingerprint of an array of lines; null for null."""
    numbers = F.transform(lines, lambda x, i: F.struct(line_number(x).alias("h"), (i + 1).cast("long").alias("i")))
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    add = lambda s, n: F.struct((s["a"] + n["h"]).alias("a"), (s["b"] + n["i"] * n["h"] % MODULUS).alias("b"))
    return F.aggregate(numbers, start, add, lambda s: _print(s["a"], s["b"]))


def running_sums(sources: DataFrame) -> DataFrame:
    """(file, line, a, b) for each line of ``sources`` (file, lines) and for line 0, where both sums are 0."""
    each = sources.select("file", F.posexplode("lines").alias("i", "text"))
    numbered = each.select("file", (F.col("i") + 1).cast("long").alias("line"), line_number(F.col("text")).alias("h"))
    every = numbered.unionByName(sources.select("file", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("h")))
    so_far = W.partitionBy("file").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return every.select("file", "line", F.sum("h").over(so_far).alias("a"), F.sum(F.col("line") * F.col("h") % MODULUS).over(so_far).alias("b"))


def windows(sources: DataFrame, lengths: DataFrame) -> DataFrame:
    """(file, length, line, print): the fingerprint of each window of the wanted ``lengths`` (file, length), by its first line."""
    sums = running_sums(sources.join(lengths.select("file").distinct(), "file", "left_semi"))
    ends = sums.join(lengths.select("file", F.col("length").cast("long").alias("length")).distinct(), "file").select("file", "length", (F.col("line") - F.col("length")).alias("line"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    both = ends.where("line >= 0 and length > 0").join(sums, ["file", "line"])
    plain = F.pmod(F.col("_a") - F.col("a"), F.lit(MODULUS))
    return both.select("file", "length", (F.col("line") + 1).alias("line"), _print(plain, F.col("_b") - F.col("b") - F.col("line") * plain).alias("print"))


#: Bytes of texts that a batch of answers holds at most, but for its last one.
ANSWER_BYTES = 16 << 20

ASKED = {"length": "long", "print": "long", "near": "long", "first": "long", "last": "long"}


def find_windows(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, start): of the windows with the text of each asked block the one nearest to where it was; of two the earlier. None: no row.

    ``asked`` has id, file, length, print and hash (of the block's lines: the
    fingerprint, null where none was kept, and the exact digest), near, and first
    and last, the lines within which it must lie; ``sources`` file and lines, a row a file.
    Blocks without a fingerprint, or whose nearest window only shares it, are
    looked for by the digest of every window.
    """

    def answer(file, *block):
        start = file.find(*block)
        return None if start is None else (start,)

    return _by_file(asked, sources, ASKED, answer, "start int")


def place_blocks(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, size, now, same, lines): a row for each asked block whose file there is, with the file's number of lines.

    ``asked`` has the columns of ``find_windows`` and follow (whether to look for
    its text, found from line now), and from, to and fixed: the lines where it
    stands if it was not found, as long as the file has them or if they are
    fixed. same tells whether they have the block's digest; lines has them if not.
    """

    def answer(file, digest, length, print_, near, first, last, follow, start, end, fixed):
        now = file.find(digest, length, print_, near, first, last) if follow else None
        if now is not None:
            start, end = now, now + length - 1
        if start is None or end is None or not (fixed or end <= file.size):
            return file.size, now, False, None
        start = max(start, 1)
        same = digest is not None and file.digest(start, end - start + 1) == digest
        return file.size, now, same, None if same else file.text(start, end - start + 1)

    return _by_file(asked, sources, ASKED | {"follow": "boolean", "from": "long", "to": "long", "fixed": "boolean"}, answer, "size int, now int, same boolean, lines array<string>")


def _by_file(asked: DataFrame, sources: DataFrame, columns: dict[str, str], answer: Callable, schema: str) -> DataFrame:
    """(id, *schema): what ``answer`` gives for a file and the hash and ``columns`` of each row asked of it; None: no row.

    Texts are shuffled once: a file's lines come before the rows asked of it,
    and one file is held at a time.
    """
    none = lambda t: F.lit(None).cast(t)
    there = sources.select("file", F.lit(0).alias("_kind"), F.transform("lines", line_number).alias("_numbers"), "lines", none(asked.schema["id"].dataType).alias("id"), none("string").alias("hash"), *(none(t).alias(c) for c, t in columns.items()))
    wanted = asked.select("file", F.lit(1).alias("_kind"), none("array<bigint>").alias("_numbers"), none("array<string>").alias("lines"), "id", "hash", *(F.col(c).cast(t) for c, t in columns.items()))
    rows = there.unionByName(wanted).where("file is not null").repartition("file").sortWithinPartitions("file", "_kind")
    given = StructType.fromDDL(schema)
    answered = to_arrow_schema(given)

    def run(batches):
        key, held = None, None
        for batch in batches:
            files, kinds, at, found, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], 0
            values = [batch.column(i) for i in range(5, 6 + len(columns))]

            def answers():
                ids = batch.column(4).take(pa.array(at))
                return pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip(zip(*found), answered))], ["id", *answered.names])

            for i in range(batch.num_rows):
                if kinds[i] == 0:
                    # null lines are no file, an empty array is a file without lines
                    key, held = files[i], (_File(batch.column(2)[i].values, batch.column(3)[i].values) if batch.column(2)[i].is_valid else None)
                elif held is not None and files[i] == key:
                    row = answer(held, *(c[i].as_py() for c in values))
                    if row is not None:
                        at.append(i)
                        found.append(row)
                        size += sum(len(x or "") for v in row if isinstance(v, list) for x in v)
                        if size > ANSWER_BYTES:
                            yield answers()
                            at, found, size = [], [], 0
            if at:
                yield answers()

    return rows.mapInArrow(run, StructType([StructField("id", asked.schema["id"].dataType), *given]))


class _File:
    """A file's lines with running sums, and the places of the fingerprints of its windows by length."""

    def __init__(self, numbers, lines):
        h = np.concatenate([[0], np.asarray(numbers.to_numpy(zero_copy_only=False), dtype=np.int64)])
        self.a, self.b = np.cumsum(h), np.cumsum(np.arange(len(h), dtype=np.int64) * h % MODULUS)
        self.lines, self.size, self.lengths, self.digests = lines, len(h) - 1, {}, {}

    def find(self, digest, length, print_, near, first, last):
        if None in (digest, length, near, first, last) or length < 1:
            return None
        low, high = max(first, 1), min(last, self.size) - length + 1
        if high < low:
            return None
        if print_ is not None:
            at = self._nearest(self._places(length, print_), near, low, high)
            if at is None or self.digest(at, length) == digest:
                return at
        if high - low < 64:
            return min((p for p in range(low, high + 1) if self.digest(p, length) == digest), key=lambda p: (abs(p - near), p), default=None)
        if length not in self.digests:
            self.digests[length] = {}
            for p in range(1, self.size - length + 2):
                self.digests[length].setdefault(self.digest(p, length), []).append(p)
        return self._nearest(self.digests[length].get(digest, []), near, low, high)

    def _places(self, length, print_):
        """First lines of the windows with a fingerprint, in order."""
        if length not in self.lengths:
            before = np.arange(self.size - length + 1, dtype=np.int64)
            plain = (self.a[length:] - self.a[: -length]) % MODULUS
            # the second sum counts places from the file's top, less those before the window
            placed = (self.b[length:] - self.b[: -length] - before * plain) % MODULUS
            prints = plain * (1 << 31) + placed
            order = np.argsort(prints, kind="stable")
            self.lengths[length] = prints[order], order + 1
        prints, places = self.lengths[length]
        return places[np.searchsorted(prints, print_, "left") : np.searchsorted(prints, print_, "right")]

    @staticmethod
    def _nearest(places, near, low, high):
        places = places[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]
        above = bisect.bisect_left(places, near)
        return min((int(p) for p in places[max(above - 1, 0) : above + 1]), key=lambda p: (abs(p - near), p), default=None)

    def text(self, at, length):
        """The lines from ``at`` on, as far as the file goes."""
        return self.lines.slice(at - 1, max(length, 0)).to_pylist()

    def digest(self, at, length):
        return hashlib.sha256("\n".join(x for x in self.text(at, length) if x is not None).encode()).hexdigest()
