"""Quality classifier: a support vector machine over Naive Bayes features.

A text's features are the indicators of its hashed n-grams: single tokens,
token pairs, and pairs and triples of token shapes (case, kind, length, whether
glued to what stands before). Each indicator is scaled by the log ratio of its
smoothed class counts; a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent, and its margins are turned into scores
by a logistic curve fitted to out-of-fold margins.

Only the fit uses a bounded sample of labelled rows (``sample`` of each class,
those with the smallest hash of doc_id, and ``most_bytes`` of their features);
scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .storage import Shared, arrow_map, give_back, materialize
from .textkit import U, chunks, mix, word_hashes

FEATURE_BITS = 18
_N = 1 << FEATURE_BITS

# byte kinds: 0 white space, 1 letter, 2 digit, 3 anything else
_kind = np.full(256, 3, dtype=np.uint8)
_kind[[0x20, *range(9, 14)]] = 0
_kind[48:58] = 2
_kind[65:91] = _kind[97:123] = _kind[128:] = 1
_upper = np.zeros(256, dtype=np.int32)
_upper[65:91] = 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the runs of one kind other than space, and each row's first."""
    kind = _kind[data]
    edge = np.ones(len(kind), dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    inner = offsets[:-1]
    edge[inner[inner < len(kind)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(kind))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    return starts, ends, kind[starts], np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray):
    """Yield the distinct feature numbers of each row."""
    starts, ends, kind, first = tokens(data, offsets)
    words = word_hashes(data, starts, ends, fold=False)
    ups = np.concatenate([[0], np.cumsum(_upper[data])])
    upper, size = ups[ends] - ups[starts], ends - starts
    case = np.where(upper == 0, 0, np.where(upper == size, 1, np.where((upper == 1) & (_upper[data[starts]] > 0), 2, 3))) if len(starts) else size
    glued = np.zeros(len(starts), dtype=np.int64)
    glued[1:] = starts[1:] == ends[:-1]
    glued[first[:-1][first[:-1] < len(starts)]] = 0  # what stands before is another row
    shape = mix(((np.minimum(size, 12) * 4 + case) * 4 + kind).astype(np.uint64) * U(2) + glued.astype(np.uint64))
    two = mix(words[:-1] * U(3) + words[1:])
    shape2 = mix(shape[:-1] * U(5) + shape[1:])
    shape3 = mix(shape[:-2] * U(7) + shape[1:-1] * U(11) + shape[2:])
    grams = [(mix(words + U(1)), 0), (two, 1), (shape2, 1), (shape3, 2)]
    grams = [((g & U(_N - 1)).astype(np.int64), back) for g, back in grams]
    seen = np.zeros(_N, dtype=np.int64)
    for i in range(len(first) - 1):
        own = np.concatenate([g[first[i] : max(first[i], first[i + 1] - back)] for g, back in grams])
        place = np.arange(len(own))
        seen[own] = place
        yield own[seen[own] == place]


def hinge_fit(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularized hinge loss; classes weigh the same. Returns weights and bias."""
    w, bias = np.zeros(len(scale)), 0.0
    x = [scale[r] for r in rows]
    norms = np.array([v @ v for v in x]) + 1
    top = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the smoothed share of each feature among positive rows over that among negative rows."""
    sums = []
    for sign in (1, -1):
        own = [r for r, s in zip(rows, y, strict=True) if s == sign]
        count = np.bincount(np.concatenate(own), minlength=_N) if own else np.zeros(_N)
        sums.append((count + smooth) / (len(own) + 2 * smooth))
    return np.log(sums[0] / sums[1])


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift)))."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margins + self.bias) + self.shift, -30, 30)))


def train(rows: list[np.ndarray], labels: np.ndarray, cost: float = 0.01, epochs: int = 20, folds: int = 3) -> Model:
    """Fit to feature rows with labels 0 and 1; with a single class (or none) every score is that class's share."""
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(_N, np.float32), 0.0, 0.0, 0.0 if not len(y) else 3.0 * float(y[0]))
    held = np.zeros(len(rows))
    part = np.arange(len(rows)) % folds
    for k in range(folds):
        fit = np.flatnonzero(part != k)
        scale = count_ratios([rows[i] for i in fit], y[fit])
        w, bias = hinge_fit([rows[i] for i in fit], scale, y[fit], cost, epochs)
        w *= scale
        for i in np.flatnonzero(part == k):
            held[i] = w[rows[i]].sum() + bias
    slope, shift = _logistic(held, y)
    scale = count_ratios(rows, y)
    w, bias = hinge_fit(rows, scale, y, cost, epochs)
    return Model((w * scale).astype(np.float32), bias, slope, shift)


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(y = 1 | margin), with both classes weighing the same and smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    beta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-6 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def held_out(modulus: int, remainder: int):
    """Whether crc32 of the doc_id's decimal text leaves the given remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held, sample: int) -> DataFrame:
    """(y, text): of each class at most ``sample`` labelled rows outside ``held``, those with the smallest hash of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null").where(~held)
    # keys first: the texts of the chosen rows alone are then moved
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("y = 1").orderBy(*rank).limit(sample).unionByName(rows.where("y = 0").orderBy(*rank).limit(sample))
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")


def bounded(rows: DataFrame, value: str, sample: int, most_bytes: int) -> DataFrame:
    """(doc_id, y, value) of ``rows``: of each class at most ``sample`` values, in the order of the hash of doc_id, of at most half of ``most_bytes``.

    A value that no longer fits is passed over. Rows alike in all three count once.
    Only keys and sizes of the candidates come to the driver.
    """
    rows = rows.withColumn("own", F.xxhash64(value))
    sizes = rows.groupBy("doc_id", "y", "own").agg(F.min(F.octet_length(value)).alias("size"))
    chosen = []
    for y in (0, 1):
        left = most_bytes // 2
        for r in sizes.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "own").limit(sample).collect():
            if r["size"] <= left:
                left -= r["size"]
                chosen.append((r["doc_id"], y, r["own"]))
    keys = rows.sparkSession.createDataFrame(chosen, "doc_id long, y int, own long")
    return rows.join(F.broadcast(keys), ["doc_id", "y", "own"]).groupBy("doc_id", "y", "own").agg(F.min(value).alias(value)).drop("own")


def fit(docs: DataFrame, labels: DataFrame, label: str, held, sample: int = 3000, most_bytes: int = 96 << 20) -> Model:
    """Train on a sample of labelled rows outside ``held``, bounded in rows (``sample`` of each class) and in bytes of their features (see ``bounded``)."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column(2)):
                rows = [np.sort(f).astype(np.int32).tobytes() for f in features(data, offsets)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(rows)), batch.column(1).slice(row, len(rows)), pa.array(rows, pa.binary())], ["doc_id", "y", "features"])

    made = materialize(labelled_sample(docs, labels, label, held, sample).transform(arrow_map, run, "doc_id long, y int, features binary"), "sample")
    found = bounded(made, "features", sample, most_bytes).collect()
    found.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    rows, labels_ = [np.frombuffer(r[2], dtype=np.int32) for r in found], np.array([r[1] for r in found], dtype=np.int64)
    del found
    model = train(rows, labels_)
    del rows
    give_back()  # the driver has little memory to spare
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with a column score (replacing one of that name) for each row's whole text (null counts as empty)."""
    docs = docs.drop("score")
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        model = shared.value
        for batch in batches:
            margins = np.zeros(batch.num_rows)
            for row, data, offsets in chunks(batch.column(at)):
                for i, own in enumerate(features(data, offsets)):
                    margins[row + i] = model.weights[own].sum(dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(margins))], names)

    names = [*docs.columns, "score"]
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.transform(arrow_map, run, schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text, ...), learnt from ``labels.quality``.

    Rows whose crc32(doc_id as text) mod 3 is 1 teach nothing. Null and empty
    texts get the score of a text without features. Without labels of both
    classes all scores are equal. Null or repeated doc_ids are scored like any row.
    """
    held = held_out(3, 1)
    model = fit(docs, labels, "quality", held, sample)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
