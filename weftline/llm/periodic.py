"""Runs of periodic repetition in the words of a text, found by comparing the word array with itself at every lag.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends, of at least ``min_words`` words and at least
``min_exp`` periods. A stretch of true values in ``words[:-q] == words[q:]``, of
m of them, is a maximal stretch of period q and m + q words; lags up to
n / min_exp suffice. The same stretch of words shows up at every multiple of its
smallest period that is short enough, so the smallest lag of equal stretches is
the run's period (a longer period of a stretch of two such periods or more is a
multiple of the smallest one).

Texts of up to ``long_bytes`` bytes are scanned many at a time, their word
arrays laid end to end, longest first. Of longer ones each range of lags, of
about ``range_work`` comparisons, is a row of its own that goes to any machine;
the stretches that ranges find are put together by a grouping.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .storage import arrow_map, materialize

LONG_BYTES = 1 << 16
RANGE_WORK = 1 << 28
#: Words whose arrays are laid end to end for one scan.
GROUP_WORDS = 1 << 16

RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
_ROW = "weftline_row"
_ALL = np.uint64(0x0101010101010101)  # eight true values


def numbered(words: list[bytes], base: int) -> np.ndarray:
    """For each word ``base`` plus the place of its first occurrence: equal numbers for equal words of one text only."""
    return np.fromiter(map({}.setdefault, words, range(base, base + len(words))), dtype=np.int32, count=len(words))


def scan(numbers: np.ndarray, first: np.ndarray, lags: tuple[int, int] | None = None, min_exp: int = 4, min_words: int = 6) -> np.ndarray:
    """Rows (text, start, length, period) of the texts whose word numbers lie end to end, text i from first[i] on.

    Only lags from lags[0] up to and without lags[1], where given; without them the rows are the texts' runs. Sorted.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    own = np.concatenate([numbers[first[i] : first[i + 1]] for i in order]) if len(order) else numbers
    low, high = lags or (1, len(numbers))
    same = np.zeros(len(own) + 24, dtype=bool)  # from 8 on, so that whole eights of it can be read at once
    found = [np.zeros((0, 3), np.int64)]
    for lag in range(low, high):
        least = max(min_words, min_exp * lag)
        texts = np.searchsorted(-sizes, -least, side="right")
        if not texts:
            break
        n = begin[texts] - lag
        np.equal(own[:n], own[lag : n + lag], out=same[8 : n + 8])
        same[n + 8 : n + 16] = False
        if least - lag >= 15 and not (same[: n // 8 * 8 + 16].view(np.uint64) == _ALL).any():
            continue  # fifteen true values in a row hold a whole eight
        edges = np.flatnonzero(same[8 : n + 9] != same[7 : n + 8])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= least - lag
        if long.any():
            found.append(np.stack([starts[long], ends[long] - starts[long] + lag, np.full(long.sum(), lag)], axis=1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        rows = rows[new]
    place = np.searchsorted(begin, rows[:, 0], side="right") - 1
    rows = np.column_stack([order[place] if len(rows) else place, rows[:, 0] - begin[place], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def without_repeats(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run (start, length, period) holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(compress(words, np.cumsum(depth[:-1]) == 0))


def _run_lists(rows: np.ndarray, texts: int) -> pa.Array:
    """One list of runs for each text, from rows (text, start, length, period) by text."""
    fields = [pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3)]
    offsets = np.searchsorted(rows[:, 0], np.arange(texts + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(RUN.fieldNames())))


def _split(value: pa.Scalar) -> list[bytes]:
    """Words between spaces and 0x09-0x0D, which are just what bytes.split() takes for white space."""
    text = value.as_py()
    return text.split() if text else []


def find_runs(docs: DataFrame, min_exp: int = 4, min_words: int = 6, long_bytes: int = LONG_BYTES, range_work: int = RANGE_WORK) -> DataFrame:
    """All columns of ``docs`` (text, ...) with ``runs``, an array of (start, length, period) by start, then period, and ``collapsed``.

    ``collapsed`` is the text's words, joined by one space, without those that a
    run repeats. Words lie between spaces and 0x09-0x0D; they are numbered from 0
    and compared byte by byte. Null and empty texts have no run and an empty
    ``collapsed``. Rows are independent, so repeated rows are all returned.
    Columns of the names ``runs`` and ``collapsed`` are replaced.
    """
    docs = docs.drop("runs", "collapsed")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    names = schema.fieldNames()

    def short(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            row = 0
            while row < batch.num_rows:
                words, arrays, first = [], [], [0]
                while row + len(words) < batch.num_rows and first[-1] < GROUP_WORDS:
                    words.append(_split(texts[row + len(words)]))
                    arrays.append(numbered(words[-1], first[-1]))
                    first.append(first[-1] + len(words[-1]))
                rows = scan(np.concatenate(arrays), np.array(first), None, min_exp, min_words)
                where = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
                kept = [without_repeats(w, rows[where[i] : where[i + 1], 1:]) for i, w in enumerate(words)]
                columns = batch.slice(row, len(words)).columns
                yield pa.RecordBatch.from_arrays([*columns, _run_lists(rows, len(words)), pa.array(kept, pa.binary()).cast(pa.string())], names)
                row += len(words)

    def ranges(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                numbers = numbered(_split(text), 0)
                lags = len(numbers) // min_exp
                step = max(1, range_work // max(1, len(numbers)))
                for low in range(1, lags + 1, step):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([low], pa.int64()), pa.array([min(low + step, lags + 1)], pa.int64()), pa.array([numbers.tobytes()], pa.binary())], [_ROW, "low", "high", "numbers"])

    def one_range(batches):
        for batch in batches:
            for key, low, high, held in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                numbers = np.frombuffer(held.as_buffer(), dtype=np.int32)
                rows = scan(numbers, np.array([0, len(numbers)]), (low, high), min_exp, min_words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key), pa.int64()), *(pa.array(rows[:, k], pa.int64()) for k in (1, 2, 3))], [_ROW, *RUN.fieldNames()])

    def finish(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            found = batch.column("runs")
            for i in range(batch.num_rows):
                runs = found.slice(i, 1).flatten()
                rows = np.column_stack([np.zeros(len(runs), np.int64), *(c.to_numpy(zero_copy_only=False) for c in runs.flatten())]).astype(np.int64)
                kept = without_repeats(_split(texts[i]), rows[:, 1:])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[: len(names) - 2], _run_lists(rows, 1), pa.array([kept], pa.binary()).cast(pa.string())], names)

    is_long = F.coalesce(F.octet_length("text") > long_bytes, F.lit(False))
    few = docs.where(~is_long).transform(arrow_map, short, schema)
    held = materialize(docs.where(is_long).withColumn(_ROW, F.monotonically_increasing_id()), "long-texts")
    dealt = held.select(_ROW, "text").transform(arrow_map, ranges, f"{_ROW} long, low long, high long, numbers binary").repartition(_ROW, "low")
    stretches = dealt.transform(arrow_map, one_range, f"{_ROW} long, start long, length long, period long")
    runs = stretches.groupBy(_ROW, "start", "length").agg(F.min("period").alias("period"))
    # a text has fewer runs than words, so a row of them is bounded by its text
    runs = runs.groupBy(_ROW).agg(F.array_sort(F.collect_list(F.struct("start", "length", "period")), _by_start).alias("runs"))
    whole = held.join(runs, _ROW, "left").select(*docs.columns, F.coalesce("runs", F.array().cast(ArrayType(RUN))).alias("runs"))
    return few.unionByName(whole.transform(arrow_map, finish, schema))


def _by_start(a, b):
    earlier = (a["start"] < b["start"]) | (a["start"] == b["start"]) & (a["period"] < b["period"])
    return F.when(earlier, -1).when((a["start"] == b["start"]) & (a["period"] == b["period"]), 0).otherwise(1)


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where the words of every tenth document, by crc32 of its doc_id, repeat from some word on.

    With h that number, g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), each word
    i >= a becomes word a + (i - a) % p. Null doc_ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def body(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

        def altered(where):
            again = lambda word, i: F.when(i < where["a"], word).otherwise(F.get(words, (where["a"] + (i - where["a"]) % where["p"]).cast("int")))
            return F.array_join(F.transform(words, again), " ")

        return F.when(n > 0, F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), altered)[0])

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.when(h % 10 == 0, F.transform(F.array(words), body)[0])
    return docs.withColumn("text", F.coalesce(planted, "text"))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) for each row of ``docs`` (doc_id, text, ...).

    start to exponent_milli describe the run of greatest length (ties: smallest
    start, then period) and are null where there is none. Null texts count as
    empty. Null or repeated doc_ids are reported as they come.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_runs(with_planted_repeats(plain)).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in RUN.fieldNames())), F.lit("\n"))), "")
    found = found.withColumns({"best": best, "lines": lines})
    start, length, period = -F.col("best.s"), F.col("best.n"), -F.col("best.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
