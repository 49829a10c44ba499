"""Centroid clustering of integer vectors, with Elkan's bounds and exact distances.

Vectors are assigned to the nearest centroid (squared Euclidean distance, ties
to the smaller number) and centroids move to the floor of their vectors' mean,
for a fixed number of rounds. A vector keeps, from round to round, an upper bound
of its distance to its centroid and a lower bound of that to each centroid;
centroids' moves loosen them, and half the distance between two centroids bounds
likewise. A centroid is passed over only if a bound says that it is strictly
farther than the vector's own. Bounds are 32-bit floats, lower ones rounded down
and upper ones up by a whole unit, so that ties are always computed; whatever is
computed is an exact 64-bit integer.

The vectors with their bounds are a table in the shared folder, written anew each
round and deleted once the next is there. Sums are taken over it by grouping, so
that a cluster of any size is added up where its rows lie.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Shared, arrow_map, discard, materialize

#: Components up to this size leave room for squared distances and their sums in 64 bits.
LARGEST = 1 << 26


def floored(vectors: DataFrame, dim: int, scale: int = 256, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component of the vectors with just ``dim`` components, none null or not finite."""
    kept = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vec"))
    kept = kept.where(F.size("vec") == dim).where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    small = lambda y: F.when(F.abs(y) <= LARGEST, y.cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST} has no exact squared distance in 64 bits")).cast("int"))
    return kept.select("vec_id", F.transform("vec", lambda x: small(F.floor(x * scale))).alias("vec"))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    apart = a - b
    return np.einsum("...j,...j->...", apart, apart)


@dataclass
class Centroids:
    """Where the centroids are, how far each has moved at most, and half of what lies between two of them at least."""

    places: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        moved = np.zeros(len(places)) if before is None else np.sqrt(squared(places, before).astype(float)) * (1 + 1e-9)
        half = np.stack([np.sqrt(squared(places, p).astype(float)) for p in places]) * (0.5 - 1e-9)
        return cls(places, moved, half)


def assign(vectors: np.ndarray, own: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, at: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, upper bound and lower bounds of each vector, and how many distances were computed.

    ``own``, ``upper`` and ``lower`` are those of the round before (None: there was none).
    """
    n, k = len(vectors), len(at.places)
    if own is None:
        apart = np.stack([squared(vectors, p) for p in at.places], axis=1)
        own = apart.argmin(axis=1)  # the first of equal ones
        roots = np.sqrt(apart.astype(float))
        return own, up(roots[np.arange(n), own]), down(roots), n * k
    own, upper, lower = own.copy(), up(upper.astype(float) + at.moved[own]), down(lower.astype(float) - at.moved)
    done = 0

    def open_(rows: np.ndarray) -> np.ndarray:
        """Which centroids may be as near as the rows' own."""
        far = (upper[rows, None] < lower[rows]) | (upper[rows, None] < at.half[own[rows]])
        far[np.arange(len(rows)), own[rows]] = True
        return ~far

    rows = np.arange(n)
    rows = rows[open_(rows).any(axis=1)]
    exact = np.zeros(n, np.int64)
    exact[rows] = squared(vectors[rows], at.places[own[rows]])
    roots = np.sqrt(exact[rows].astype(float))
    upper[rows], lower[rows, own[rows]] = up(roots), down(roots)
    done += len(rows)
    left = open_(rows)
    rows, left = rows[left.any(axis=1)], left[left.any(axis=1)]
    for c in range(k):
        # the bounds get tighter as nearer centroids are found
        on = rows[left[:, c]]
        on = on[(own[on] != c) & ~(upper[on] < lower[on, c]) & ~(upper[on] < at.half[own[on], c])]
        if not len(on):
            continue
        apart = squared(vectors[on], at.places[c])
        done += len(on)
        roots = np.sqrt(apart.astype(float))
        lower[on, c] = down(roots)
        nearer = (apart < exact[on]) | (apart == exact[on]) & (c < own[on])
        on, roots = on[nearer], roots[nearer]
        own[on], exact[on], upper[on] = c, apart[nearer], up(roots)
    return own, upper, lower, done


_STATE = "vec_id long, vec array<int>, cluster int, upper float, lower binary, computed long"


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(state: DataFrame, at: Centroids, dim: int, first: bool) -> DataFrame:
    shared = Shared(state.sparkSession, at)
    k = len(at.places)

    def run(batches):
        at = shared.value
        for batch in batches:
            vectors = _vectors(batch.column(1), dim)
            if first:
                own, upper, lower, done = assign(vectors, None, None, None, at)
            else:
                held = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.float32).reshape(-1, k)
                own, upper, lower, done = assign(vectors, batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy(), held, at)
            computed = np.zeros(len(own), np.int64)
            computed[:1] = done
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(upper), pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(computed)], ["vec_id", "vec", "cluster", "upper", "lower", "computed"])

    return state.transform(arrow_map, run, _STATE)


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors (all, if fewer) with smallest SHA-256 of ``salt:vec_id``; null vec_ids last, equal ones by components."""
    key = F.sha2(F.concat(F.lit(salt + ":"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r["vec"] for r in rows], dtype=np.int64)


def moved(state: DataFrame, places: np.ndarray) -> np.ndarray:
    """Each centroid at the floor of the mean of its vectors; one without vectors stays."""
    sums = [F.sum(F.get("vec", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(places.shape[1])]
    out = places.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row a centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(places.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, vec, cluster, distance) for each row of ``vectors`` (vec_id, vec array<int>), and the final centroids.

    ``k`` bounds what the driver holds: k centroids and their sums. With fewer
    vectors than ``k`` there is a centroid for each; equal ones take their place
    in order of their number, so the later of them stay empty. No vectors: no
    centroids.
    """
    places = seeds(vectors, k, salt)
    if not len(places):
        return vectors.select("vec_id", "vec", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), places.reshape(0, dim)
    state, before = materialize(_assigned(vectors, Centroids.of(places), dim, True), "vectors"), None
    for _ in range(rounds):
        before, places = places, moved(state, places)
        old, state = state, materialize(_assigned(state, Centroids.of(places, before), dim, False), "vectors")
        discard(old)
    last = Shared(vectors.sparkSession, places)

    def run(batches):
        for batch in batches:
            apart = squared(_vectors(batch.column(1), dim), last.value[batch.column(2).to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(apart)], ["vec_id", "vec", "cluster", "distance"])

    return state.select("vec_id", "vec", "cluster").transform(arrow_map, run, "vec_id long, vec array<int>, cluster int, distance long"), places


def digests(embeddings: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept row of ``embeddings`` (vec_id, embedding, ...).

    Kept are vectors of ``dim`` components, none null or not finite. Rows stay as
    they are: repeated and null vec_ids have a row for each. A component beyond
    2**26 after scaling is an error, as distances would not fit.
    """
    found, places = cluster(floored(embeddings, dim), k, rounds, dim)
    spark = embeddings.sparkSession
    by_cluster = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(by_cluster.values())
    rows = [(c, int(by_cluster.get(c, 0)), int(total), hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest()) for c, p in enumerate(places)]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
