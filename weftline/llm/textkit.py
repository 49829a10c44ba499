"""Words and word shingles of Arrow text batches, in numpy over the UTF-8 bytes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased;
both rules are safe on UTF-8. A word's hash chains a 64-bit mixer over its
lanes of eight bytes, all words at once, so that no Python object is made for a
word; two words of the same length up to eight bytes never share a hash, others
with a chance of 2**-64. Words of more than LONG bytes are digested one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 20

_space = np.zeros(256, dtype=bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_letters = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_STEP = U(_BASE)
_powers: list = [None, None]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if _powers[0] is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for slot, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[slot] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """Yield (first row, bytes, row offsets) for runs of rows of about ``most`` bytes; a longer row comes alone."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (with the end appended)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_space[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hash_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any short span follows."""
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_letters[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of overlapping spans, for look-ups of spans far shorter than 1024 bytes: from there on a polynomial modulo 2**64 is no sound hash."""
    found = (sums[ends] - sums[starts]) * powers(len(sums))[1][starts]
    return mix(found + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


LONG = 256
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)


def lanes(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """For each byte the eight bytes from there on, as an integer; zeros follow the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = _fold[data] if fold else data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, of its A-Z-folded form if ``fold``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight, left = lanes(data, fold), ends - starts
    out = mix(left.astype(np.uint64) + _STEP)
    for i in np.flatnonzero(left > LONG):
        own = data[starts[i] : ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((_fold[own] if fold else own).tobytes(), digest_size=8).digest(), "little")
    live = np.flatnonzero((left > 0) & (left <= LONG))
    place, left, own = starts[live], left[live], out[live]
    while len(live):
        own = mix(own ^ (eight[place] & _KEEP[np.minimum(left, 8)]))
        out[live] = own
        on = np.flatnonzero(left > 8)
        live, place, left, own = live[on], place[on] + 8, left[on] - 8, own[on]
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes at a[i] and at b[i], sizes[i] of each, are equal."""
    out = np.ones(len(a), dtype=bool)
    for i in np.flatnonzero((sizes > LONG) & (a != b)):
        out[i] = np.array_equal(data[a[i] : a[i] + sizes[i]], data[b[i] : b[i] + sizes[i]])
    eight = lanes(data)
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG) & (a != b))
    at = 0
    while len(live):
        keep = _KEEP[np.minimum(sizes[live] - at, 8)]
        equal = (eight[a[live] + at] & keep) == (eight[b[live] + at] & keep)
        out[live[~equal]] = False
        at += 8
        live = live[equal & (sizes[live] > at)]
    return out


_PLACE = np.random.default_rng(7).integers(1, 2**64 - 1, 64, dtype=np.uint64) | U(1)


def shingles(words: np.ndarray, first: np.ndarray, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and for each row the index of its first one.

    A row with 1 to k-1 words gives one shingle, of all its words, if ``whole_if_short``.
    """
    counts = np.diff(first)
    long_enough = counts >= k
    sizes = np.where(long_enough, counts - k + 1, (counts > 0) & whole_if_short)
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(sizes, out=out_first[1:])
    out = np.empty(out_first[-1], np.uint64)
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled += words[j : len(words) - k + 1 + j] * _PLACE[j]
        inside = np.ones(len(rolled), bool)
        for back in range(1, k):
            edge = first[1:] - back
            inside[edge[(edge >= 0) & (edge < len(rolled))]] = False
        # a start within a row that has at least k words
        out[np.repeat(long_enough, sizes)] = mix(rolled[inside])
    if whole_if_short:
        for row in np.flatnonzero(~long_enough & (counts > 0)):
            own = words[first[row] : first[row + 1]]
            whole = (own * _PLACE[: len(own)]).sum(keepdims=True) + U(len(own))
            out[out_first[row]] = mix(whole)[0]
    return out, out_first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and where each row begins."""
    parts = [np.unique(values[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])
