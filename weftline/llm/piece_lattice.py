"""Sampled SentencePiece encoding and lossless decoding.

All segmentations of a text into vocabulary pieces form a lattice over its
bytes. A forward pass sums the probabilities of all paths to each position; a
backward pass then draws one segmentation from the exact posterior. Its random
numbers are hashes of seed, row key and place, so that results do not depend on
partitions, batches or retries.

No piece spans the place before a space that follows another character, so the
posterior factors there: each distinct stretch between such places is filtered
once a batch, and every occurrence is sampled on its own. Stretches are found
equal by hash and then compared byte by byte. Short ones go through both passes
side by side, one array step for each place; a long one (text in a script without
spaces) goes alone, in a plain loop over its edges.

Spaces are pieces' U+2581; one is put before each text and taken off again on
decoding. A U+2581 of the text itself, like any character without a piece, is
spelled in byte pieces, so every text comes back unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Shared, arrow_map
from .textkit import U, chunks, hash_sums, mix, same_spans, span_hashes, text_bytes, word_hashes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = 0x20
_STEP = U(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 19
#: Bytes from which a stretch is a long one. It depends on the stretch alone, so that its pieces do not depend on others.
LONG = 512
#: Places of a long stretch whose edges are Python objects at a time.
BLOCK = 1 << 14
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS


@dataclass
class Vocabulary:
    """hashes, ids, scores: of ordinary pieces, sorted by hash; slots: two hash tables of their places; byte_ids: of the 256 byte pieces."""

    hashes: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    slots: tuple[np.ndarray, np.ndarray]
    lengths: np.ndarray
    byte_ids: np.ndarray
    byte_scores: np.ndarray
    inner: np.ndarray
    begin: np.ndarray
    pool: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of pieces with these hashes, -1 where there is none."""
        place = self.slots[0][hashes & U(SLOTS - 1)]
        missed = np.flatnonzero(self.hashes[place] != hashes)
        second = self.slots[1][hashes[missed] >> U(64 - SLOT_BITS)]
        place[missed] = np.where(self.hashes[second] == hashes[missed], second, -1)
        return place


def vocabulary(pieces: list[tuple[bytes, float]], byte_pieces: dict[int, int], ids: list[int], size: int, alpha: float = 1.0) -> Vocabulary:
    """Build from ordinary pieces (UTF-8 with 0x20 for U+2581, log probability) and their ids, and byte value -> id.

    ``alpha`` scales log probabilities: 1 samples from the model, larger values come closer to the best segmentation.
    """
    if sorted(byte_pieces) != list(range(256)):
        raise ValueError("the model needs a byte piece for every byte")
    spelled = [p for p, _ in pieces]
    if any(b" " in p.lstrip(b" ") for p in spelled):
        raise ValueError("a piece has a space after another character")
    data = np.frombuffer(b"".join(spelled), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in spelled])
    hashes = span_hashes(hash_sums(data), ends - [len(p) for p in spelled], ends)
    order = np.argsort(hashes)
    hashes = hashes[order]
    slots = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
    low, high = hashes & U(SLOTS - 1), hashes >> U(64 - SLOT_BITS)
    slots[0][low] = np.arange(len(hashes))
    rest = np.flatnonzero(slots[0][low] != np.arange(len(hashes)))  # those that another one displaced
    slots[1][high[rest]] = rest
    if (slots[1][high[rest]] != rest).any():
        raise ValueError("two pieces share both hash slots")
    scores = np.array([s for _, s in pieces]) * alpha
    inner = np.zeros(256, dtype=bool)  # bytes that ordinary pieces contain
    inner[data] = True
    by_id = [b""] * size
    for i, p in zip(ids, spelled, strict=True):
        by_id[i] = p
    for value, i in byte_pieces.items():
        by_id[i] = bytes([value])
    begin = np.concatenate([[0], np.cumsum([len(p) for p in by_id])])
    byte_ids = np.array([byte_pieces[b] for b in range(256)])
    floor = scores.min() if len(scores) else 0.0
    return Vocabulary(hashes, np.array(ids)[order], scores[order], slots, np.unique([len(p) for p in spelled]), byte_ids, np.full(256, floor), inner, begin, np.frombuffer(b"".join(by_id), dtype=np.uint8))


def load(path: str, alpha: float = 1.0) -> Vocabulary:
    """From a model file on the driver.

    A model whose scores are merge ranks (BPE) has no probabilities; a piece of rank r then gets
    one in proportion to 1 / (r + 1), as frequencies follow ranks. Other scores are log probabilities.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    bytes_ = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    ids = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    scores = np.array([model.get_score(i) for i in ids], dtype=np.float64)
    if len(scores) and (scores == np.round(scores)).all() and scores.min() < -1000:
        ranks = np.minimum(-scores, n)
        scores = -np.log(ranks + 1)
        scores -= np.log(np.exp(scores).sum())
    pieces = [(model.id_to_piece(i).replace("▁", " ").encode(), float(s)) for i, s in zip(ids, scores, strict=True)]
    return vocabulary(pieces, bytes_, ids, n, alpha)


def _stretches(data: np.ndarray, rows: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Starts of the stretches between which no piece spans."""
    cut = np.zeros(len(data), dtype=bool)
    cut[rows[rows < len(data)]] = True
    space = data == _SPACE
    cut[1:] |= space[1:] & ~space[:-1]
    alone = (data < 0x80) & ~inner[data]
    cut |= alone
    cut[1:] |= alone[:-1]
    return np.flatnonzero(cut)


def _lattice(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, v: Vocabulary):
    """Filter the given stretches (each once).

    Returns, for edges sorted by (stretch, end, falling length): their length, id, and cumulative posterior share among
    the edges of that end; each place's first edge; and the number of places before each stretch's first.
    """
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.repeat(np.arange(len(starts)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = data[starts[owner] + offset]
    left = sizes[owner] - offset
    at, lengths, ids, scores = [], [], [], []
    wide = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
    lead = (flat < 0x80) | (flat >= 0xC0)
    lone = np.ones(len(flat), dtype=bool)
    live, sums = np.flatnonzero(lead), hash_sums(flat)
    for n in v.lengths:
        live = live[left[live] >= n]
        if not len(live):
            break
        place = v.find(span_hashes(sums, live, live + n))
        hit = place >= 0
        where, place = live[hit], place[hit]
        at.append(where)
        lengths.append(np.full(len(where), n))
        ids.append(v.ids[place])
        scores.append(v.scores[place])
        whole = where[wide[where] == n]
        for k in range(4):
            lone[whole[wide[whole] > k] + k] = False
    # characters without a piece of their own are spelled byte by byte
    spelled = np.flatnonzero(lone)
    at.append(spelled)
    lengths.append(np.ones(len(spelled), dtype=np.int64))
    ids.append(v.byte_ids[flat[spelled]])
    scores.append(v.byte_scores[flat[spelled]])
    at, lengths, ids, scores = map(np.concatenate, (at, lengths, ids, scores))
    target = base[owner[at]] + offset[at] + lengths
    order = np.lexsort((-lengths, target))
    at, lengths, ids, scores, target = at[order], lengths[order], ids[order], scores[order], target[order]
    source = target - lengths
    total = np.full(base[-1], -np.inf)
    total[base[:-1]] = 0
    share = np.empty(len(at))
    long = sizes[owner[at]] >= LONG
    _filter_short(np.flatnonzero(~long), offset[at] + lengths, source, target, scores, total, share)
    begin = np.searchsorted(target, np.arange(base[-1]))
    for i in np.flatnonzero(sizes >= LONG):
        _filter_long(base[i] + 1, base[i + 1], begin, source, target, scores, total, share)
    last = np.append(target[1:] != target[:-1], True)
    share[last] = 1.0  # whatever rounding says
    return lengths, ids, share, begin, base[:-1]


def _filter_short(edges: np.ndarray, end: np.ndarray, source: np.ndarray, target: np.ndarray, scores: np.ndarray, total: np.ndarray, share: np.ndarray) -> None:
    """Fill ``total`` of places and ``share`` of edges, for one end after the other in all stretches at once."""
    edges = edges[np.argsort(end[edges], kind="stable")]
    source, target, scores, end = source[edges], target[edges], scores[edges], end[edges]
    bounds = np.searchsorted(end, np.arange(1, (end[-1] if len(end) else 0) + 2))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        value = total[source[low:high]] + scores[low:high]
        group = np.flatnonzero(np.diff(target[low:high], prepend=-1))
        summed = np.logaddexp.reduceat(value, group)
        total[target[low:high][group]] = summed
        width = np.diff(np.append(group, high - low))
        part = np.exp(value - np.repeat(summed, width))
        running = np.cumsum(part)
        share[edges[low:high]] = running - np.repeat(running[group] - part[group], width)


def _filter_long(first: int, stop: int, begin: np.ndarray, source: np.ndarray, target: np.ndarray, scores: np.ndarray, total: np.ndarray, share: np.ndarray) -> None:
    """The same for the places ``first`` to ``stop`` of one stretch, edge by edge."""
    for low in range(first, stop, BLOCK):
        high = min(low + BLOCK, stop)
        edge = int(begin[low])
        to = int(begin[high]) if high < len(begin) else len(target)
        if edge == to:
            continue
        back = int(source[edge:to].min())
        known = total[back:high].tolist()
        ends, starts, weights = (target[edge:to] - back).tolist(), (source[edge:to] - back).tolist(), scores[edge:to].tolist()
        shares = [1.0] * len(ends)
        i, n = 0, len(ends)
        while i < n:
            place, j = ends[i], i + 1
            while j < n and ends[j] == place:
                j += 1
            if j == i + 1:
                known[place] = known[starts[i]] + weights[i]
            else:
                values = [known[starts[e]] + weights[e] for e in range(i, j)]
                top = max(values)
                parts = [math.exp(x - top) for x in values]
                whole = sum(parts)
                known[place] = top + math.log(whole)
                running = 0.0
                for e, part in enumerate(parts, i):
                    running += part
                    shares[e] = running / whole
            i = j
        total[back:high] = known
        share[edge:to] = shares


def _draw_long(salt: np.uint64, low: int, place: int, lengths: np.ndarray, ids: np.ndarray, share: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ids of one sampled segmentation of a long stretch, whose places are ``low`` to ``place``, last piece first."""
    drawn = []
    while place > low:
        bottom = max(low, place - BLOCK)
        random = _uniform(salt, np.arange(bottom - low + 1, place - low + 1)).tolist()
        edge = int(begin[bottom + 1])
        to = int(begin[place + 1]) if place + 1 < len(begin) else len(share)
        shares, wide, pieces = share[edge:to].tolist(), lengths[edge:to].tolist(), ids[edge:to].tolist()
        first = (begin[bottom + 1 : place + 1] - edge).tolist()
        while place > bottom:
            e, r = first[place - bottom - 1], random[place - bottom - 1]
            while shares[e] <= r:
                e += 1
            drawn.append(pieces[e])
            place -= wide[e]
    return np.array(drawn, dtype=np.int32)


def _uniform(salt, place: np.ndarray) -> np.ndarray:
    """A number from 0 to below 1 for each place (counted from its stretch's first)."""
    return (mix(salt + place.astype(np.uint64) * _STEP) >> U(11)).astype(np.float64) / 2.0**53


def _kinds(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sample of each distinct stretch, and each stretch's place among the samples; equal means equal bytes."""
    _, sample, kind = np.unique(word_hashes(data, starts, starts + sizes, fold=False), return_index=True, return_inverse=True)
    own = sample[kind]
    odd = np.flatnonzero((sizes != sizes[own]) | ~same_spans(data, starts, starts[own], np.minimum(sizes, sizes[own])))
    more: dict[bytes, int] = {}
    for i in odd:
        kind[i] = more.setdefault(data[starts[i] : starts[i] + sizes[i]].tobytes(), len(sample))
        if kind[i] == len(sample):
            sample = np.append(sample, i)
    return sample, kind


def encode_batch(column: pa.Array, keys: np.ndarray, v: Vocabulary, seed: int):
    """Yield (row, ids of all rows of a chunk in order, where each row's begin)."""
    for row, data, offsets in chunks(column, CHUNK_BYTES):
        filled = np.flatnonzero(np.diff(offsets) > 0)
        data = np.insert(data, offsets[:-1][filled], _SPACE)
        rows = offsets + np.concatenate([[0], np.cumsum(np.diff(offsets) > 0)])
        if not len(filled):
            yield row, np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
            continue
        starts = _stretches(data, rows[:-1], v.inner)
        sizes = np.diff(np.append(starts, len(data)))
        first = np.searchsorted(starts, rows)
        sample, kind = _kinds(data, starts, sizes)
        lengths, ids, share, begin, base = _lattice(data, starts[sample], sizes[sample], v)
        own = np.repeat(np.arange(len(first) - 1), np.diff(first))
        nth = np.arange(len(starts)) - first[own]
        salt = mix(mix(keys[row + own] + U(seed) * _STEP) + nth.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        live = np.flatnonzero(sizes < LONG)
        place = base[kind[live]] + sizes[live]
        drawn, count = [], np.zeros(len(starts), dtype=np.int64)
        while len(live):
            random = _uniform(salt[live], place - base[kind[live]])
            edge = begin[place]
            on = np.flatnonzero(share[edge] <= random)
            while len(on):
                edge[on] += 1
                on = on[share[edge[on]] <= random[on]]
            drawn.append((live, ids[edge]))
            count[live] += 1
            place = place - lengths[edge]
            going = place > base[kind[live]]
            live, place = live[going], place[going]
        alone = [(i, _draw_long(salt[i], base[kind[i]], base[kind[i]] + sizes[i], lengths, ids, share, begin)) for i in np.flatnonzero(sizes >= LONG)]
        for i, some in alone:
            count[i] = len(some)
        after = np.cumsum(count)
        out = np.empty(after[-1], dtype=np.int32)
        for step, (which, some) in enumerate(drawn):
            out[after[which] - 1 - step] = some
        for i, some in alone:
            out[after[i] - len(some) : after[i]] = some[::-1]
        yield row, out, np.append(0, after)[first]


def decode_ids(ids: np.ndarray, first: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, and where each row begins."""
    sizes = v.begin[ids + 1] - v.begin[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(ends[-1]) + np.repeat(v.begin[ids] - ends[:-1], sizes)
    filled = np.diff(first) > 0
    keep = np.ones(ends[-1], dtype=bool)
    keep[ends[first[:-1][filled]]] = False  # the space before each text
    return v.pool[where][keep], ends[first] - np.concatenate([[0], np.cumsum(filled)])


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """(doc_id, pieces array<int>): one sampled segmentation of each row's whole text.

    The row key is doc_id; rows that share it and their text get equal pieces. A
    null doc_id counts as -1, a null or empty text gives no pieces. Other
    columns play no part.
    """
    shared = Shared(docs.sparkSession, load(model, alpha))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            keys = np.asarray(ids.fill_null(-1)).astype(np.int64).view(np.uint64)
            for row, out, first in encode_batch(batch.column(1), keys, shared.value, seed):
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(out, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(first) - 1), lists], ["doc_id", "pieces"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, "doc_id long, pieces array<int>")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text): the texts that ``encode`` was given (null texts come back empty)."""
    shared = Shared(encoded.sparkSession, load(model))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                some = lists.slice(at, 256)
                first = np.concatenate([[0], np.cumsum(np.diff(np.asarray(some.offsets)))]).astype(np.int64)
                data, offsets = decode_ids(np.asarray(some.flatten()).astype(np.int64), first, shared.value)
                raw = pa.Array.from_buffers(pa.large_utf8(), len(some), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), raw.cast(pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.coalesce("pieces", F.array().cast("array<int>")).alias("pieces")).transform(arrow_map, run, "doc_id long, text string")


def digests(docs: DataFrame, model: str = DEFAULT_MODEL, seed: int = 1, alpha: float = 1.0) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, decoded_sha256, lossless) for each row, without moving pieces through the JVM.

    pieces_sha256 is of the ids as little-endian 32-bit integers, decoded_sha256 of the decoded bytes.
    """
    import hashlib

    shared = Shared(docs.sparkSession, load(model, alpha))

    def run(batches):
        v = shared.value
        for batch in batches:
            ids = batch.column(0)
            keys = np.asarray(ids.fill_null(-1)).astype(np.int64).view(np.uint64)
            data, offsets = text_bytes(batch.column(1))
            for row, out, first in encode_batch(batch.column(1), keys, v, seed):
                back, begin = decode_ids(out.astype(np.int64), first, v)
                n = len(first) - 1
                texts = [back[begin[i] : begin[i + 1]].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, n),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([hashlib.sha256(out[first[i] : first[i + 1]].astype("<i4").tobytes()).hexdigest() for i in range(n)]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([t == data[offsets[row + i] : offsets[row + i + 1]].tobytes() for i, t in enumerate(texts)]),
                    ],
                    ["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"],
                )

    schema = "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, schema)
