"""Toxicity: a convolutional text classifier, trained in numpy.

Words (letter runs, A-Z folded) have embeddings that are the sum of hashed table
rows: one of the word and one of each of its beginnings of PREFIXES bytes. Filters of several widths run over the words; the largest response
of each filter anywhere in the text goes to a logistic output. A threshold is
calibrated for each language on rows held back from training, the language
being guessed from function words of the text itself; the score is the logistic
of the distance from that threshold, so 0.5 is the decision everywhere.

Only the fit uses a bounded sample of labelled rows; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .nbsvm import held_out, labelled_sample, tokens
from .storage import Shared, arrow_map, give_back, materialize
from .textkit import U, chunks, mix, word_hashes

BUCKETS = 1 << 16
PREFIXES = (4, 6)
PARTS = 1 + len(PREFIXES)
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS, MOST_EPOCHS, VISITS = 8, 30, 60_000
BATCH = 32
MOST_WORDS = 1 << 16

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as at be this have from or by",
    "de": "der die und das nicht ein eine ist mit den von zu auf für sich dem des auch im",
    "fr": "le la les des et est un une que qui dans pour pas sur au du en ce il elle",
    "es": "el los las que y en un una por con para su al lo como más del se es no",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return word_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def _word_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter runs and of their beginnings (words, PARTS), and each row's first word."""
    starts, ends, kind, _ = tokens(data, offsets)
    letters = kind == 1
    starts, ends = starts[letters], ends[letters]
    parts = [word_hashes(data, starts, e) for e in (ends, *(np.minimum(ends, starts + n) for n in PREFIXES))]
    return np.stack(parts, axis=1), np.searchsorted(starts, offsets)


def languages(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES of each row: the language with most function words, the last one without any."""
    words, counts = words[:, 0], []
    for listed in FUNCTION_WORDS.values():
        known = np.sort(_hash_words(listed.split()))
        at = np.searchsorted(known, words)
        at[at == len(known)] = 0
        hit = np.concatenate([[0], np.cumsum(known[at] == words)])
        counts.append(hit[first[1:]] - hit[first[:-1]])
    counts = np.array(counts)
    return np.where(counts.max(axis=0) > 0, counts.argmax(axis=0), len(LANGUAGES) - 1)


_PART = BUCKETS * np.arange(PARTS)


def _places(words: np.ndarray) -> np.ndarray:
    """Each word's row within each part of the table, in two bytes."""
    return (mix(words + U(11)) & U(BUCKETS - 1)).astype(np.uint16)


def _slots(words: np.ndarray) -> np.ndarray:
    """The table rows of each word: one in each part of the table."""
    return _places(words) + _PART


def _times(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A product whose rows do not depend, even in rounding, on what other rows there are."""
    out = vectors[:, :1] * matrix[0]
    for d in range(1, len(matrix)):
        out += vectors[:, d : d + 1] * matrix[d]
    return out


@dataclass
class Network:
    table: np.ndarray = field(default_factory=lambda: np.random.default_rng(8).normal(0, 0.1, (PARTS * BUCKETS, DIM)).astype(np.float32))
    filters: list[np.ndarray] = field(default_factory=lambda: [np.random.default_rng(w).normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS])
    out: np.ndarray = field(default_factory=lambda: np.random.default_rng(9).normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS * len(WIDTHS), np.float32))
    bias: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def pooled(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(rows, filters): the largest response of each filter; rows shorter than a filter (and negative responses) give 0."""
        _, sample, at = np.unique(words[:, 0], return_index=True, return_inverse=True)
        vectors = self.table[_slots(words[sample])].sum(axis=1)
        return self.pool(vectors, at, first)

    def pool(self, vectors: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The same for words ``at`` places in a table of vectors."""
        out = np.zeros((len(first) - 1, FILTERS * len(WIDTHS)), np.float32)
        for k, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            n = len(at) - width + 1
            if n <= 0:
                continue
            response = _times(vectors, f[0])[at[:n]]
            for j in range(1, width):
                response += _times(vectors, f[j])[at[j : n + j]]
            some = np.flatnonzero(np.diff(first) >= width)
            if len(some):
                # segments [first, last start], and what lies between them
                edges = np.stack([first[some], first[some + 1] - width + 1], axis=1).ravel()
                edges = edges[:-1] if edges[-1] >= n else edges
                out[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(response, edges, axis=0)[::2] + self.offset[k * FILTERS : (k + 1) * FILTERS], 0)
        return out

    def logits(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        return (self.pooled(words, first) * self.out).sum(axis=1, dtype=np.float64) + self.bias

    def logits_of(self, rows: list[np.ndarray]) -> np.ndarray:
        """The same for rows of table places, as ``train`` gets them."""
        pooled = [self.pool(self.table[r + _PART].sum(axis=1), np.arange(len(r)), np.array([0, len(r)])) for r in rows]
        return (np.concatenate(pooled) * self.out).sum(axis=1, dtype=np.float64) + self.bias


def _parts(sizes: np.ndarray):
    """Runs of documents of at most MOST_WORDS words together; a longer one comes alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > MOST_WORDS:
            yield start, i
            start, total = i, 0
        total += size
    yield start, len(sizes)


def _gradient(net: Network, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted logistic loss, summed over the documents.

    (table rows (hits, PARTS), their values (hits, DIM), filters, offsets, output, bias);
    a table row has one value for each hit.
    """
    rows, values = [np.zeros((0, PARTS), np.int64)], [np.zeros((0, DIM), np.float32)]
    g_filters = [np.zeros_like(f) for f in net.filters]
    g_out, g_offset, g_bias = np.zeros_like(net.out), np.zeros_like(net.offset), 0.0
    sizes = np.array([len(d) for d in docs])
    for low, high in _parts(sizes):
        slots = np.concatenate(docs[low:high]) + _PART
        vectors = net.table[slots].sum(axis=1)
        size = sizes[low:high]
        first = np.concatenate([[0], np.cumsum(size)])
        pool, best = np.zeros((high - low, len(net.out)), np.float32), []
        for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            some = np.flatnonzero(size >= width)
            at = np.zeros((len(some), FILTERS), np.int64)
            if len(some):
                n = len(vectors) - width + 1
                response = sum(vectors[j : n + j] @ f[j] for j in range(width))
                for i, row in enumerate(some):
                    at[i] = first[row] + response[first[row] : first[row + 1] - width + 1].argmax(axis=0)
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                pool[some, own] = np.maximum(response[at, np.arange(FILTERS)] + net.offset[own], 0)
            best.append((some, at))
        p = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.bias, -30, 30)))
        d = (weight[low:high] * (p - y[low:high])).astype(np.float32)
        g_out += d @ pool
        g_bias += float(d.sum())
        back = d[:, None] * net.out * (pool > 0)
        g_offset += back.sum(axis=0)
        for k, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            some, at = best[k]
            own = back[some, k * FILTERS : (k + 1) * FILTERS]
            hit, filter_ = np.nonzero(own)
            own, at = own[hit, filter_][:, None], at[hit, filter_]
            for j in range(width):
                np.add.at(g_filters[k][j].T, filter_, vectors[at + j] * own)
                rows.append(slots[at + j])
                values.append(f[j].T[filter_] * own)
    return np.concatenate(rows), np.concatenate(values), g_filters, g_offset, g_out, g_bias


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct table rows and the sum of the values of each."""
    each = rows.ravel()
    order = np.argsort(each, kind="stable")
    each = each[order]
    starts = np.flatnonzero(np.diff(each, prepend=-1))
    return each[starts], np.add.reduceat(values[order // PARTS], starts, axis=0)


def train(docs: list[np.ndarray], labels: np.ndarray, language: np.ndarray, seed: int = 3) -> Network:
    """Fit to rows of word places with labels 0 and 1; with a single class (or none) all scores are on that class's side."""
    net = Network()
    labels, language = np.asarray(labels), np.asarray(language)
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.bias = -1.0 if not len(labels) or labels[0] == 0 else 1.0
        return net
    order = np.random.default_rng(seed).permutation(len(docs))
    held = np.zeros(len(docs), dtype=bool)
    held[order[: len(docs) // 5]] = True
    share = np.where(labels == 1, 0.5 / max((labels == 1).mean(), 1e-9), 0.5 / max((labels == 0).mean(), 1e-9))
    squares = {"table": np.full(PARTS * BUCKETS, 1e-3, np.float32), "out": np.full_like(net.out, 1e-3), "offset": np.full_like(net.offset, 1e-3), "bias": 1e-3, "filters": [np.full_like(f, 1e-3) for f in net.filters]}
    fit = np.flatnonzero(~held)
    for epoch in range(int(np.clip(VISITS // max(len(fit), 1), EPOCHS, MOST_EPOCHS))):
        rate = 0.15 / (1 + epoch / 3)
        shuffled = np.random.default_rng(seed + 1 + epoch).permutation(fit)
        for at in range(0, len(shuffled), BATCH):
            some = shuffled[at : at + BATCH]
            rows, values, g_filters, g_offset, g_out, g_bias = _gradient(net, [docs[i] for i in some], labels[some], share[some])
            for f, g, s in zip(net.filters, g_filters, squares["filters"], strict=True):
                s += g * g
                f -= rate * g / np.sqrt(s)
            for name, g in (("out", g_out), ("offset", g_offset)):
                squares[name] += g * g
                value = getattr(net, name)
                value -= rate * g / np.sqrt(squares[name])
            squares["bias"] += g_bias * g_bias
            net.bias -= rate * g_bias / np.sqrt(squares["bias"])
            if len(rows):
                where, g = _summed(rows, values)
                squares["table"][where] += (g * g).sum(axis=1)
                net.table[where] -= rate * g / np.sqrt(squares["table"][where])[:, None]
    some = np.flatnonzero(held)
    logits, language = net.logits_of([docs[i] for i in some]), language[some]
    overall = _threshold(logits, labels[some])
    for k in range(len(LANGUAGES)):
        own = language == k
        enough = min((labels[some][own] == c).sum() for c in (0, 1)) >= 20
        net.thresholds[k] = _threshold(logits[own], labels[some][own]) if enough else overall
    return net


def _threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The middle of the best gap by true minus false positive rate (0 if a class is missing)."""
    if len(set(y.tolist())) < 2:
        return 0.0
    order = np.argsort(-logits, kind="stable")
    value, hit = logits[order], y[order] == 1
    gain = np.cumsum(hit) / hit.sum() - np.cumsum(~hit) / (~hit).sum()
    ends = np.append(value[:-1] > value[1:], True)  # equal values fall on one side
    best = np.flatnonzero(ends)[gain[ends].argmax()]
    return float((value[best] + value[best + 1]) / 2) if best + 1 < len(value) else float(value[best]) - 1e-6


def fit(docs: DataFrame, labels: DataFrame, label: str, held, sample: int = 4000, most_bytes: int = 64 << 20) -> Network:
    """Train on a bounded sample of labelled rows outside ``held``.

    Of each class at most ``sample`` rows, in the order of the hash of doc_id, whose
    words take at most half of ``most_bytes`` (six bytes a word); a row that no longer
    fits is passed over. Rows alike in doc_id, label and words count once.
    """

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                words, first = _word_rows(data, offsets)
                n = len(first) - 1
                places = np.ascontiguousarray(_places(words))
                rows = pa.array([places[first[i] : first[i + 1]].tobytes() for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(languages(words, first), pa.int32()), rows], ["doc_id", "y", "language", "places"])

    rows = materialize(labelled_sample(docs, labels, label, held, sample).transform(arrow_map, run, "doc_id long, y int, language int, places binary"), "sample")
    rows = rows.withColumn("own", F.xxhash64("places"))
    sizes = rows.groupBy("doc_id", "y", "own").agg(F.min(F.octet_length("places")).alias("size"))
    chosen = []
    for y in (0, 1):
        left = most_bytes // 2
        for r in sizes.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(sample).collect():
            if r.size <= left:
                left -= r.size
                chosen.append((r.doc_id, y, r.own))
    keys = docs.sparkSession.createDataFrame(chosen, "doc_id long, y int, own long")
    once = rows.join(F.broadcast(keys), ["doc_id", "y", "own"]).groupBy("doc_id", "y", "own").agg(F.min("language"), F.min("places"))
    found = sorted(once.collect(), key=lambda r: (r[0], r[1], r[2]))
    rows = [np.frombuffer(r[4], np.uint16).reshape(-1, PARTS) for r in found]
    net = train(rows, np.array([r[1] for r in found], dtype=np.int64), np.array([r[3] for r in found], dtype=np.int64))
    del rows, found
    give_back()
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` with a column score (replacing one of that name) for each row's whole text (null counts as empty)."""
    docs = docs.drop("score")
    shared = Shared(docs.sparkSession, net)

    def run(batches):
        net = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, data, offsets in chunks(batch.column(at)):
                words, first = _word_rows(data, offsets)
                margin = net.logits(words, first) - net.thresholds[languages(words, first)]
                scores[row : row + len(first) - 1] = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names)

    names = [*docs.columns, "score"]
    at = docs.columns.index("text")
    return docs.transform(arrow_map, run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...), learnt from ``labels.toxic``.

    Rows whose crc32(doc_id as text) mod 5 is 0 teach nothing. Null and empty
    texts get the score of a text without words. Without labels of both classes
    all scores lie on one side. Null or repeated doc_ids are scored like any row.
    """
    held = held_out(5, 0)
    net = fit(docs, labels, "toxic", held, sample)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
