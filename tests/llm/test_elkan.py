import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import elkan


def plain(rows, k, rounds, dim):
    """Every distance in every round, in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    places = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((apart(v, p), c) for c, p in enumerate(places))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(places)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                places[c] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    name = lambda p: hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()
    return [(i, c, d, sum(e for _, o, e in found if o == c), total, name(places[c])) for i, c, d in found]


def table_of(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return made.withColumns({c: F.lit("clash") for c in ("vec", "cluster", "distance", "upper", "lower", "label")})


def same(got, expected):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_plain_algorithm_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    # few values a component: many equal distances, and equal vectors
    rows = [(i, (rng.integers(-3, 4, 4) / 256 * (1 + 30 * (i % 5 == 0))).tolist()) for i in range(400)]
    rows += [(400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 0.0, 0.0]), (404, [float("nan")] * 4), (405, [float("inf"), 0.0, 0.0, 0.0]), (7, rows[8][1]), (7, rows[7][1]), (None, [0.5, -0.001, 0.0, 3.0])]
    same(elkan.digests(table_of(spark, rows), k=9, rounds=4, dim=4).collect(), plain(rows, 9, 4, 4))


def test_few_equal_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [0.1, 0.2])]
    same(elkan.digests(table_of(spark, rows), k=40, rounds=5, dim=2).collect(), plain(rows, 40, 5, 2))
    assert elkan.digests(table_of(spark, rows).limit(0), dim=2).collect() == []
    assert elkan.digests(table_of(spark, rows), dim=3).collect() == []


def test_too_large_a_component_is_an_error(spark):
    with pytest.raises(Exception, match="no exact squared distance"):
        elkan.digests(table_of(spark, [(1, [1e30, 0.0])]), dim=2).collect()


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-40, 40, (300, 8)) + 500 * rng.integers(-2, 3, 8) for _ in range(12)])
    at = elkan.Centroids.of(vectors[rng.permutation(len(vectors))[:12]])
    own, upper, lower, every = elkan.assign(vectors, None, None, None, at)
    spent = []
    for _ in range(5):
        places = np.array([vectors[own == c].sum(axis=0) // max(1, (own == c).sum()) if (own == c).any() else at.places[c] for c in range(12)])
        at = elkan.Centroids.of(places, at.places)
        own, upper, lower, done = elkan.assign(vectors, own, upper, lower, at)
        apart = np.stack([elkan.squared(vectors, p) for p in places], axis=1)
        assert (own == apart.argmin(axis=1)).all()
        assert (upper.astype(float) ** 2 >= apart[np.arange(len(own)), own]).all()
        assert (lower.astype(float) ** 2 <= apart).all()
        spent.append(done)
    assert every == len(vectors) * 12 and max(spent) < every and spent[-1] < every / 4
