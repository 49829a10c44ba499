"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

For each item of n words, all n-word windows of all documents are searched for
fingerprints within ``RADIUS`` of the item's; a document of fewer words is itself
the window. Fingerprints (64 bits, a majority
vote of word hashes) are cut into BLOCKS blocks; by the pigeonhole principle two
fingerprints within RADIUS differ by at most BLOCK_RADIUS bits in some block.
Items are entered under all block values within ITEM_FLIPS of their own, and
windows look up all within the remaining flips of theirs, which finds every such
pair. Candidates are confirmed by the exact similarity of
weighted shingle multisets: sum of min over sum of max of the counts, each
shingle weighted by the bytes of its words.

A window is fingerprinted only if the weight of its shingles that occur in any
item reaches the threshold's share of its own weight. This is an upper bound of
the similarity to every item, so nothing that could be confirmed is skipped.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Shared, arrow_map
from .textkit import U, chunks, mix, shingles, word_hashes, word_spans

BLOCKS, BLOCK_BITS, BLOCK_RADIUS, ITEM_FLIPS = 4, 16, 3, 1
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: The search structure over one block of items has about so many bytes at most; each block is one pass over the documents.
BLOCK_BYTES = 64 << 20
#: What an item takes in the structure, and what each byte of its text does; both are upper estimates.
ITEM_BYTES, TEXT_BYTES = 1500, 16
#: Window starts whose words are voted on together.
STRIDE = 4096

_BIT = np.arange(64, dtype=np.uint64)


def _flips(most: int) -> np.ndarray:
    """All block values with at most so many bits."""
    return np.array([sum(1 << b for b in some) for r in range(most + 1) for some in itertools.combinations(range(BLOCK_BITS), r)], dtype=np.uint64)


_ITEM_NEAR, _WINDOW_NEAR = _flips(ITEM_FLIPS), _flips(BLOCK_RADIUS - ITEM_FLIPS)


def _ones(words: np.ndarray) -> np.ndarray:
    """Prefix sums (words + 1, 64) of the bits of the words' hashes."""
    sums = np.zeros((len(words) + 1, 64), dtype=np.int32)
    np.cumsum((mix(words + U(0x51))[:, None] >> _BIT) & U(1), axis=0, out=sums[1:], dtype=np.int32)
    return sums


def _vote(ones: np.ndarray, n: int) -> np.ndarray:
    return ((2 * ones >= n).astype(np.uint64) << _BIT).sum(axis=1, dtype=np.uint64)


def _prints(words: np.ndarray, starts: np.ndarray, width: int, ones: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of the windows of ``width`` words at the rising ``starts``; memory goes with the width, not with the text, unless ``ones`` of all words are given."""
    if ones is not None:
        return _vote(ones[starts + width] - ones[starts], width)
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + STRIDE))
        own = starts[at:end] - starts[at]
        ones = _ones(words[starts[at] : starts[end - 1] + width])
        out[at:end] = _vote(ones[own + width] - ones[own], width)
        at = end
    return out


def _weighted(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles with their weight times their count."""
    found, at = np.unique(values, return_inverse=True)
    return found, np.bincount(at, weights=weights, minlength=len(found))


def _similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Items:
    """The search structure over one block of items."""

    def __init__(self, ids: list[int], texts: list[str], k: int) -> None:
        self.k = k
        kept: list[tuple[int, np.ndarray, np.ndarray]] = []
        for row, data, offsets in chunks(pa.array(texts, pa.string())):
            starts, ends, first = word_spans(data, offsets)
            words, sizes = word_hashes(data, starts, ends), ends - starts
            kept += [(ids[row + i], words[first[i] : first[i + 1]], sizes[first[i] : first[i + 1]]) for i in range(len(first) - 1) if first[i] < first[i + 1]]
        self.ids = np.array([x[0] for x in kept], dtype=np.int64)
        self.lengths = np.array([len(x[1]) for x in kept], dtype=np.int64)
        sets = [_weighted(*self.shingles(w, s, min(k, len(w)))) for _, w, s in kept]
        self.first = np.concatenate([[0], np.cumsum([len(v) for v, _ in sets])]).astype(np.int64)
        self.values, self.weights = (np.concatenate([x[i] for x in sets]) if sets else np.zeros(0) for i in (0, 1))
        self.prints = np.array([_vote(_ones(w)[-1:], len(w))[0] for _, w, _ in kept], dtype=np.uint64)
        #: item shingles by their number of words: a sorted array and a small table of low bits before it
        self.known = {}
        for size in np.unique(np.minimum(self.lengths, k)):
            values = np.unique(self.values[np.repeat(np.minimum(self.lengths, k) == size, np.diff(self.first))])
            table = np.zeros(1 << int(np.clip(np.ceil(np.log2(32 * len(values))), 12, 26)), dtype=bool)
            table[values & U(len(table) - 1)] = True
            self.known[int(size)] = (values, table)
        # (item length, block, block value) -> items, for all values near an item's
        keys, owners = [], []
        for block in range(BLOCKS):
            own = (self.prints >> U(block * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)
            keys.append((self._key(self.lengths[:, None], block) | (own[:, None] ^ _ITEM_NEAR)).ravel())
            owners.append(np.repeat(np.arange(len(kept), dtype=np.int32), len(_ITEM_NEAR)))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def set_of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.first[item], self.first[item + 1])
        return self.values[own], self.weights[own]

    @staticmethod
    def _key(length: np.ndarray | int, block: int) -> np.ndarray:
        return (np.asarray(length).astype(np.uint64) << U(20)) | U(block << BLOCK_BITS)

    @staticmethod
    def shingles(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        values, _ = shingles(words, np.array([0, len(words)]), k)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return values, (total[k:] - total[:-k]).astype(np.float64)

    def hits(self, values: np.ndarray, size: int) -> np.ndarray:
        """Which shingles of ``size`` words occur in an item."""
        known, table = self.known[size]
        out = table[values & U(len(table) - 1)]
        maybe = np.flatnonzero(out)
        at = np.searchsorted(known, values[maybe])
        at[at == len(known)] = 0
        out[maybe] = known[at] == values[maybe]
        return out

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) index pairs with fingerprints within RADIUS, for items of this length."""
        low, high = np.searchsorted(self.keys, [self._key(length, 0), self._key(length + 1, 0)])
        keys, owners = self.keys[low:high], self.owners[low:high]
        distinct, kind = np.unique(prints, return_inverse=True)
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(distinct), STRIDE):
            some = distinct[at : at + STRIDE]
            for block in range(BLOCKS):
                own = (some >> U(block * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)
                wanted = (self._key(length, block) | (own[:, None] ^ _WINDOW_NEAR)).ravel()
                low = np.searchsorted(keys, wanted)
                hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == wanted) if len(keys) else low[:0]
                low, high = low[hit], np.searchsorted(keys, wanted[hit], "right")
                count = high - low
                items = owners[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
                found.append((at + np.repeat(hit // len(_WINDOW_NEAR), count)) * len(self.ids) + items)
        which, item = np.divmod(np.unique(np.concatenate(found)), max(len(self.ids), 1))
        close = np.bitwise_count(distinct[which] ^ self.prints[item]) <= RADIUS
        which, item = which[close], item[close]
        # back from distinct fingerprints to windows
        order = np.argsort(kind, kind="stable")
        first = np.searchsorted(kind[order], which)
        count = np.bincount(kind, minlength=len(distinct))[which]
        return order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)], np.repeat(item, count)

    def search(self, words: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity) of the best window of each item that one document holds."""
        best: dict[int, tuple[float, int, int]] = {}
        ones = None
        for size, lengths in self._by_size():
            if len(words) < size:
                continue
            values, weights = self.shingles(words, sizes, size)
            hit = self.hits(values, size)
            if not hit.any():
                continue
            held = np.concatenate([[0], np.cumsum(np.where(hit, weights, 0))])
            total = np.concatenate([[0], np.cumsum(weights)])
            for n in lengths:
                width = min(n, len(words))
                span = width - size + 1
                start = np.flatnonzero(held[span:] - held[:-span] >= threshold * (total[span:] - total[:-span]) - 1e-9)
                if not len(start):
                    continue
                if ones is None and len(words) <= STRIDE:
                    ones = _ones(words)
                prints = _prints(words, start, width, ones)
                for window, item in zip(*self.near(prints, n), strict=True):
                    at = int(start[window])
                    s = _similarity(_weighted(values[at : at + span], weights[at : at + span]), self.set_of(item))
                    if s >= threshold and (item not in best or (s, -at) > (best[item][0], -best[item][1])):
                        best[item] = (s, at, int(np.bitwise_count(prints[window] ^ self.prints[item])))
        return [(int(self.ids[i]), at, min(int(self.lengths[i]), len(words)), distance, s) for i, (s, at, distance) in best.items()]

    def _by_size(self):
        for size in self.known:
            yield size, sorted({int(n) for n in self.lengths if min(n, self.k) == size})


SCHEMA = "doc_id long, item_id long, window_start long, window_words long, distance long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, window_start, window_words, distance, similarity): the best window of each item in each document.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Only pairs
    with a similarity of at least ``threshold`` are put out; of equally similar
    windows the first counts. window_start counts words from 0. A document of
    fewer words than an item is compared with it as a whole.

    Null and empty texts, on either side, hold nothing. An item of fewer than k
    words has one shingle, all its words. Rows of a repeated doc_id or item_id
    give one row with their best window. Other columns play no part; without
    documents or items the result is empty.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for items in _item_blocks(benchmark, k):
        found = found.unionByName(_search(docs, items, threshold))
    best = F.max_by(F.struct("window_start", "window_words", "distance", "similarity"), F.struct("similarity", -F.col("window_start"), -F.col("distance")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("w")).select("doc_id", "item_id", "w.*")


def clean(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text holds no window that similar to an item.

    The same search as in ``contaminated``, as a filter: nothing is joined or moved.
    """
    for items in _item_blocks(benchmark, k):
        docs = _without(docs, items, threshold)
    return docs


def _item_blocks(benchmark: DataFrame, k: int):
    """Yield the broadcast search structures of all items; the hash deals them out evenly over blocks of bounded size."""
    benchmark = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = benchmark.agg(F.sum(ITEM_BYTES + TEXT_BYTES * F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Shared(benchmark.sparkSession, Items([r[0] for r in rows], [r[1] for r in rows], k))


def _hits(index: Items, texts: pa.Array, threshold: float):
    """Yield (row, matches) for the rows that hold an item."""
    for row, data, offsets in chunks(texts):
        starts, ends, first = word_spans(data, offsets)
        words, sizes = word_hashes(data, starts, ends), ends - starts
        for i in _touched(index, words, first):
            own = slice(first[i], first[i + 1])
            if found := index.search(words[own], sizes[own], threshold):
                yield row + int(i), found


def _search(docs: DataFrame, items, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[i], *x) for i, found in _hits(items.value, batch.column(1), threshold) for x in found]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in names])
    return docs.transform(arrow_map, run, SCHEMA)


def _without(docs: DataFrame, items, threshold: float) -> DataFrame:
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for row, _ in _hits(items.value, batch.column(at), threshold):
                keep[row] = False
            yield batch.filter(pa.array(keep))

    return docs.transform(arrow_map, run, docs.schema)


def _touched(index: Items, words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows with at least one shingle of an item; the others cannot hold a window."""
    rows = np.zeros(len(first) - 1, dtype=bool)
    for size in index.known:
        values, begin = shingles(words, first, size, whole_if_short=False)
        rows[np.searchsorted(begin, np.flatnonzero(index.hits(values, size)), side="right") - 1] = True
    return np.flatnonzero(rows)
