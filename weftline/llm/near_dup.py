"""Near-duplicate documents: SetSketch bands, joint likelihood estimates, exact verification.

1. Every text becomes a set of word shingles, its SetSketch registers and a
   128-bit key of the set. Rows with equal sets form a class, which is the node
   of all later steps and is never paired within itself.
2. Bands of register values put similar classes into common buckets. Every
   member of a bucket is compared with the bucket's smallest member: first by
   the likelihood estimate from both sketches, then on the full sets.
3. A bucket whose members then still lie in more than one component is compared
   completely, apart from pairs inside the component of its smallest member.
   This is done in cells of two blocks of bounded size. Cells first hold sketches
   only; the members with a likely partner then meet again with their full sets.
   Nothing but confirmed links is put out; a pair is looked at in the first band
   only that its two sketches share.
4. Confirmed links are joined to components.

Bands are as long as the threshold lets them be with a chance below 1e-6 that
two sets just at it share none, and the estimate's bar lies six standard errors
below the threshold. Every candidate pair is confirmed or refused on full sets
of 64-bit shingle hashes; there is no cap on buckets. Keys that many rows may
share (a bucket, its smallest member) are dealt over parts of about FAN rows
before anything is joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import setsketch
from .components import components
from .storage import arrow_map, materialize
from .textkit import U, chunks, distinct, mix, shingles, text_bytes, word_hashes, word_spans

#: A block has about a sixteenth of its bucket's members, but from the first to the second number of them, and at most about so many shingles.
BLOCK, BLOCK_SHINGLES = (1024, 4096), 1 << 18
#: Rows of one key that are joined under one part of it.
FAN = 256
SLACK = 6 * 0.033
PAIRS = 1 << 16
CELL = ["band", "bucket", "x", "y", "outer"]


def _sets(column: pa.Array, k: int, short: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in chunks(column):
        starts, ends, first = word_spans(data, offsets)
        yield row, *distinct(*shingles(word_hashes(data, starts, ends), first, k, short))


def signatures(docs: DataFrame, k: int = 3, short: bool = True) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hi, set_lo, registers) for each row of ``docs``; a null text has an empty set."""

    def run(batches):
        for batch in batches:
            for row, values, first in _sets(batch.column(2), k, short):
                rows = len(first) - 1
                sizes = np.diff(first)
                registers = setsketch.sketch(values, first)
                keys = []
                for salt in (1, 2):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + U(salt)), dtype=np.uint64)])
                    keys.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                own = [batch.column(c).slice(row, rows) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sizes, pa.int64()), *(pa.array(x, pa.int64(), mask=sizes == 0) for x in keys), pa.array([r.tobytes() for r in registers], pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "set_hi", "set_lo", "registers"],
                )

    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("text_key"), text.alias("text"))
    return docs.transform(arrow_map, run, "doc_id long, text_key binary, n_shingles long, set_hi long, set_lo long, registers binary")


def text_key(text: Column) -> Column:
    """What tells the texts of one doc_id apart."""
    return F.unhex(F.md5(text))


def bands(sketches: DataFrame, rows: int) -> DataFrame:
    """(band, bucket, id): one row for each class and band of ``rows`` registers."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = setsketch.band_keys(_registers(batch.column(1)), rows)
                flat = pa.array(keys.ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "keys"])

    keyed = sketches.select("id", "registers").transform(arrow_map, run, "id long, keys array<long>")
    return keyed.select("id", F.posexplode("keys").alias("band", "bucket"))


def full_sets(texts: DataFrame, k: int, short: bool) -> DataFrame:
    """(id, elements): the sorted shingle hashes of each text (id, text), eight bytes each."""

    def run(batches):
        for batch in batches:
            for row, values, first in _sets(batch.column(1), k, short):
                rows = [values[a:b].astype("<u8").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(rows)), pa.array(rows, pa.binary())], ["id", "elements"])

    return texts.select("id", "text").transform(arrow_map, run, "id long, elements binary")


def _registers(column: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(column)
    return np.ascontiguousarray(data[offsets[0] : offsets[-1]]).view(np.uint16).reshape(-1, setsketch.REGISTERS)


def _elements(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u8") for x in column]


def _confirmed(percent: int, common: np.ndarray, total: np.ndarray) -> np.ndarray:
    return 100 * common >= percent * (total - common)


def _may_link(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The similarity is at most that of the sizes."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _part(rows: str, by: str) -> Column:
    """Which part of its key a row belongs to, by the number of rows of the key."""
    return F.pmod(F.xxhash64(by), F.ceil(F.col(rows) / FAN)).cast("int").alias("part")


def _parts(rows: str) -> Column:
    """One row for each part of a key."""
    return F.explode(F.sequence(F.lit(0), F.ceil(F.col(rows) / FAN).cast("int") - 1)).alias("part")


def _with_ends(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """``pairs`` (a, b, n) with the columns of ``table`` (id, ...) for both ends, as a_* and b_*; n bounds the pairs of each a."""
    names = [c for c in table.columns if c != "id"]
    of = lambda end: table.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in names))
    heads = pairs.groupBy("a").agg(F.max("n").alias("n")).join(of("a"), "a").select("a", _parts("n"), *(f"a_{c}" for c in names))
    return pairs.withColumn("part", _part("n", "b")).join(heads, ["a", "part"]).join(of("b"), "b").drop("part")


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n) whose similarity may reach the threshold by both sketches (id, n_shingles, registers)."""
    bar = percent / 100 - SLACK

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (np.asarray(batch.column(c)) for c in (3, 5))
                ok = _may_link(n_a, n_b, percent)
                ok &= setsketch.jaccard(_registers(batch.column(4)), _registers(batch.column(6)), n_a, n_b) >= bar
                yield batch.select(["a", "b", "n"]).filter(pa.array(ok))

    columns = ["a", "b", "n", "a_n_shingles", "a_registers", "b_n_shingles", "b_registers"]
    return _with_ends(pairs, sketches).select(columns).transform(arrow_map, run, "a long, b long, n long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, n) whose full sets (id, elements) have 100 * common >= percent * united."""

    def run(batches):
        for batch in batches:
            left, right = _elements(batch.column(2)), _elements(batch.column(3))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)], dtype=np.int64)
            good = _confirmed(percent, common, np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], dtype=np.int64))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return _with_ends(pairs, sets).select("a", "b", "a_elements", "b_elements").transform(arrow_map, run, "a long, b long")


def _whole_cells(batches) -> Iterator[pa.Table]:
    """The rows of batches sorted by CELL, cut where the cell changes only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = int(_cell_starts(table)[-1])
            if last:
                yield table.slice(0, last)
            held = table.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def _cell_starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for name in CELL:
        values = _column(table, name)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _likely_pairs(table: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (left, right) of different components across the sides of each cell, or within a cell of one block, that may be links.

    Rows are sorted by cell and side. At most about PAIRS pairs are looked at together.
    """
    starts = _cell_starts(table)
    cell = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    ends = np.append(starts[1:], table.num_rows)[cell]
    side, component, size, band = (_column(table, c) for c in ("side", "component", "n_shingles", "band"))
    middle = (starts + np.bincount(cell, weights=side == 0, minlength=len(starts)).astype(np.int64))[cell]
    inner = (_column(table, "x") == _column(table, "y")) & (_column(table, "outer") == 0)
    begin = np.where(inner, np.arange(table.num_rows) + 1, middle)
    count = np.where(side == 0, ends - begin, 0)
    registers = _registers(table.column("registers").combine_chunks())
    width = setsketch.band_rows(percent / 100)
    rows = np.flatnonzero(count > 0)
    cuts = np.searchsorted(np.cumsum(count[rows]), np.arange(PAIRS, count.sum() + PAIRS, PAIRS), side="left") + 1
    for some in np.split(rows, np.unique(cuts[cuts < len(rows)])):
        left = np.repeat(some, count[some])
        right = np.arange(len(left)) + np.repeat(begin[some] - np.cumsum(count[some]) + count[some], count[some])
        ok = (component[left] != component[right]) & _may_link(size[left], size[right], percent)
        left, right = left[ok], right[ok]
        if len(left):
            shared = (registers[left] == registers[right]).reshape(len(left), -1, width).all(axis=2)
            ok = (shared.argmax(axis=1) == band[left]) & shared[np.arange(len(left)), band[left]]
            left, right = left[ok], right[ok]
        if len(left):
            ok = setsketch.jaccard(registers[left], registers[right], size[left], size[right]) >= percent / 100 - SLACK
            if ok.any():
                yield left[ok], right[ok]


def _bits(sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    table = np.zeros((len(sets), len(universe)), dtype=bool)
    for row, own in enumerate(sets):
        at = np.searchsorted(universe, own)
        at[at == len(universe)] = 0
        table[row, at[universe[at] == own]] = True
    packed = np.packbits(table, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by bit sets over slices of the shared elements."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, len(shared), 1 << 13):
        a, b = _bits(left, shared[at : at + (1 << 13)]), _bits(right, shared[at : at + (1 << 13)])
        for row in range(len(a)):
            out[row] += np.bitwise_count(a[row] & b).sum(axis=1, dtype=np.int64)
    return out


def _common_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of row pairs: together where they fill much of a grid, else pair by pair."""
    rows, i = np.unique(left, return_inverse=True)
    columns, j = np.unique(right, return_inverse=True)
    if 8 * len(left) > len(rows) * len(columns) > 64:
        return _common([sets[r] for r in rows], [sets[c] for c in columns])[i, j]
    return np.array([len(np.intersect1d(sets[r], sets[c], assume_unique=True)) for r, c in zip(left, right, strict=True)], dtype=np.int64)


def _touched(cells: DataFrame, percent: int) -> DataFrame:
    """The rows of sorted cells that have a likely partner in their cell."""

    def run(batches):
        for table in _whole_cells(batches):
            mark = np.zeros(table.num_rows, dtype=bool)
            for left, right in _likely_pairs(table, percent):
                mark[left] = mark[right] = True
            if mark.any():
                yield from table.drop_columns(["n_shingles", "registers"]).filter(pa.array(mark)).to_batches()

    return cells.transform(arrow_map, run, cells.drop("n_shingles", "registers").schema)


def _links(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links of sorted cells with full sets, as many as join the same components."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for table in _whole_cells(batches):
            sets, ids, component = _elements(table.column("elements").combine_chunks()), _column(table, "id"), _column(table, "component").tolist()
            starts, found = _cell_starts(table), []
            for left, right in _likely_pairs(table, percent):
                apart = np.array([find(component[i]) != find(component[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True)])
                left, right = left[apart], right[apart]
                cell = np.searchsorted(starts, left, side="right")
                for own in np.split(np.arange(len(left)), np.flatnonzero(np.diff(cell)) + 1):
                    if not len(own):
                        continue
                    total = np.array([len(sets[i]) + len(sets[j]) for i, j in zip(left[own], right[own], strict=True)])
                    good = own[_confirmed(percent, _common_of(sets, left[own], right[own]), total)]
                    for i, j in zip(left[good].tolist(), right[good].tolist(), strict=True):
                        # members of one component are connected already: one link joins two components
                        p, q = find(component[i]), find(component[j])
                        if p != q:
                            root[p] = q
                            found.append((ids[i], ids[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return cells.transform(arrow_map, run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, short: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text, ...).

    Documents link when 100 * |common| >= percent * |united| over their sets of
    k-word shingles; component_id is the smallest doc_id that links reach.
    With ``short``, a text of fewer than k words counts as one shingle.

    A null or empty text has no shingles and stands alone. Every row is judged by
    its own text, also if another row has the same doc_id. A row without doc_id
    links like any other; its component is null only if no row of it has a
    doc_id. Other columns play no part. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(signatures(docs, k, short), "signatures")
    key = ["set_hi", "set_lo"]
    known = signed.where("n_shingles > 0")
    sample = F.first(F.struct(F.col("doc_id").alias("sample_doc"), "text_key", "n_shingles", "registers")).alias("sample")
    first = known.groupBy(*key).agg(F.min("doc_id").alias("least_doc"), sample)
    # the ids are written here and only read from now on
    classes = materialize(first.select(F.monotonically_increasing_id().alias("id"), *key, "least_doc", "sample.*"), "classes")
    sketches = classes.select("id", "n_shingles", "registers")
    banded = bands(sketches, setsketch.band_rows(percent / 100))
    buckets = banded.groupBy("band", "bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = materialize(banded.join(buckets, ["band", "bucket"]), "members")
    sets = _sets_of(docs, classes.join(members.select("id").distinct(), "id"), k, short)

    star = members.where("id <> pivot").groupBy(F.col("pivot").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    links = materialize(verify(materialize(likely(star, sketches, percent), "likely"), sets, percent), "links")
    more = materialize(_within_buckets(members, components(links), sketches, sets, percent), "more-links")
    joined = materialize(components(links.union(more)).toDF("id", "component"), "components")
    grouped = classes.select("id", "least_doc").join(joined, "id").groupBy("component").agg(F.min("least_doc").alias("component_id"))
    grouped = joined.join(grouped, "component").select("id", "component_id")
    classed = classes.join(grouped.withColumn("linked", F.lit(True)), "id", "left").select(*key, F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_doc")).alias("component_id"))
    found = known.select("doc_id", "n_shingles", *key).join(classed, key).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _sets_of(docs: DataFrame, classes: DataFrame, k: int, short: bool) -> DataFrame:
    """(id, elements) of the classes, from the text of one row of each."""
    wanted = materialize(classes.select("id", "sample_doc", F.col("text_key").alias("sample_key")), "wanted")
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    same = keyed.doc_id.eqNullSafe(wanted.sample_doc) & (keyed.text_key == wanted.sample_key)
    # wanted grows with the corpus; both sides are dealt by text key, which only repeated rows share
    sets = materialize(full_sets(keyed.join(wanted.hint("merge"), same).select("id", "text"), k, short), "sets")
    if sets.count() == wanted.count():
        return sets
    # some row occurs more than once
    return materialize(sets.groupBy("id").agg(F.first("elements").alias("elements")), "single-sets")


def _within_buckets(members: DataFrame, comps: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside the buckets that the comparison with their smallest members left in several components."""
    bucket = ["band", "bucket", "part"]
    of = lambda name: comps.toDF("id", name)
    heads = members.where("n > 2 and id = pivot").join(of("main"), "id", "left").select("band", "bucket", _parts("n"), F.coalesce("main", "id").alias("main"))
    rows = members.where("n > 2 and id <> pivot").select("band", "bucket", _part("n", "id"), "id", "n")
    rows = rows.join(heads, bucket).join(of("component"), "id", "left").join(sketches.select("id", "n_shingles"), "id")
    rows = rows.withColumn("component", F.coalesce("component", "id"))
    rows = materialize(rows.withColumn("rest", F.col("component") != F.col("main")), "bucket-rows")
    in_rest = lambda value: F.sum(F.when(F.col("rest"), value).otherwise(0))
    in_main = lambda value: F.sum(F.when(F.col("rest"), 0).otherwise(value))
    one, size = F.lit(1), F.col("n_shingles")
    counts = rows.groupBy("band", "bucket").agg(F.max("n").alias("n"), in_rest(one).alias("n_rest"), in_main(one).alias("n_main"), in_rest(size).alias("w_rest"), in_main(size).alias("w_main"))
    block = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.col("n") / 16))
    blocks = lambda s: F.ceil(F.greatest(F.col(f"n_{s}") / block, F.col(f"w_{s}") / BLOCK_SHINGLES)).cast("int").alias(f"b_{s}")
    counts = counts.where("n_rest > 0 and n_rest + n_main > 1").select("band", "bucket", _parts("n"), blocks("rest"), blocks("main"))
    rows = rows.join(counts, bucket)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("b_rest")).otherwise(F.col("b_main"))).cast("int")
    rows = rows.withColumn("own", own)
    # (left block of the rest, right block, whether the right one is of the main component, side)
    cell = lambda x, y, outer, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(outer).alias("outer"), side.cast("int").alias("side"))
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("own")
    among_rest = F.transform(up_to("b_rest"), lambda j: cell(F.least(mine, j), F.greatest(mine, j), 0, (j < mine).cast("int")))
    to_main = F.transform(up_to("b_main"), lambda j: cell(mine, j, 1, F.lit(0)))
    from_main = F.transform(up_to("b_rest"), lambda i: cell(i, mine, 1, F.lit(1)))
    cells = F.explode(F.when(F.col("rest"), F.concat(among_rest, to_main)).otherwise(from_main)).alias("cell")
    dealt = rows.select("band", "bucket", "id", "component", cells).select("band", "bucket", "cell.*", "id", "component")
    met = lambda df: df.join(sketches, "id").repartition(*CELL).sortWithinPartitions(*CELL, "side")
    return _links(met(_touched(met(dealt), percent).join(sets, "id")), percent)
