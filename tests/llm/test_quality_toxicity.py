import random
import zlib

import numpy as np
import pytest

from weftline.llm import nbsvm, toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "un") for b in ("ra", "sel", "to", "ven", "dor", "is")]
    rows, quality, toxic = [], [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = [w.upper() + "!!" for w in text]
        if rude:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["grubful", "grubbish", "snarkle"]))
        rows.append((i, " ".join(text)))
        quality.append((i, int(not bad), int(rude)))
    return rows, quality


@pytest.fixture
def labelled(docs, spark):
    rows, labels = corpus(700, 3)
    extra = [(10_000, None), (10_001, ""), (10_002, "\n\t "), (None, "some text"), (5, rows[5][1]), (10_003, "zor " * 20000)]
    return docs(rows + extra), spark.createDataFrame(labels + [(None, 1, 1), (10_000, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "label", "modulus", "remainder"), [(nbsvm.quality, 1, 3, 1), (toxicity.toxicity, 2, 5, 0)])
def test_held_out_accuracy(labelled, run, label, modulus, remainder):
    docs, labels = labelled
    got = run(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in got)
    truth = {r[0]: r[label] for r in labels.collect() if r[0] is not None and r[1] is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    five = [r.score for r in got if r.doc_id == 5]
    assert len(five) == 2 and five[0] == five[1]
    again = {(r.doc_id, r.score) for r in run(docs.repartition(5), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_labels_of_held_out_rows_teach_nothing(labelled, spark):
    from pyspark.sql import functions as F

    docs, labels = labelled
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted((r.doc_id or -1, r.score) for r in nbsvm.quality(docs, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in nbsvm.quality(docs, labels).collect())


@pytest.mark.parametrize("run", [nbsvm.quality, toxicity.toxicity])
def test_without_labels_or_rows(labelled, run):
    docs, labels = labelled
    assert len({r.score for r in run(docs, labels.limit(0)).collect()}) == 1
    assert run(docs.limit(0), labels).collect() == []


def test_features_are_distinct_and_rows_are_apart():
    from weftline.llm.textkit import text_bytes
    import pyarrow as pa

    texts = ["One two, One two", "", "two!!", None, "ÉTÉ 12ab"]
    together = [sorted(f.tolist()) for f in nbsvm.features(*text_bytes(pa.array(texts)))]
    alone = [sorted(next(iter(nbsvm.features(*text_bytes(pa.array([t], pa.string()))))).tolist()) for t in texts]
    assert together == alone
    assert all(len(f) == len(set(f)) for f in together)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(60)]
    y = np.where(np.array([len(set(r) & {1, 2, 3, 4}) for r in rows]) > 0, 1, -1)
    scale, cost = rng.normal(1, 0.2, 30), 0.1
    w, b = nbsvm.hinge_fit(rows, scale, y, cost, 3000)
    top = np.where(y > 0, cost * 60 / (2 * (y > 0).sum()), cost * 60 / (2 * (y < 0).sum()))

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(t * max(0, 1 - s * (w[r] @ scale[r] + b)) for r, s, t in zip(rows, y, top))

    best = loss(w, b)
    assert all(best <= loss(w + rng.normal(0, 0.01, 30), b + rng.normal(0, 0.01)) + 1e-3 for _ in range(200))


def test_pooling_equals_a_plain_loop():
    net = toxicity.Network()
    rng = np.random.default_rng(0)
    rows = [rng.integers(1, 2**63, (n, toxicity.PARTS), dtype=np.uint64) for n in (0, 1, 2, 5, 40)]
    words, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    pooled = net.pooled(words, first)
    for i, own in enumerate(rows):
        vectors = net.table[toxicity._slots(own)].sum(axis=1) if len(own) else np.zeros((0, toxicity.DIM))
        for k, (width, f) in enumerate(zip(toxicity.WIDTHS, net.filters)):
            windows = [sum(vectors[s + j] @ f[j] for j in range(width)) for s in range(len(own) - width + 1)]
            expected = np.maximum(np.max(windows, axis=0), 0) if windows else np.zeros(toxicity.FILTERS)
            assert np.allclose(pooled[i, k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS], expected, atol=1e-4)


def plain_gradient(net, docs, y, weight):
    """One document, filter and position at a time."""
    table, filters = np.zeros_like(net.table), [np.zeros_like(f) for f in net.filters]
    out, offset, bias = np.zeros_like(net.out), np.zeros_like(net.offset), 0.0
    for doc, target, w in zip(docs, y, weight, strict=True):
        vectors = [net.table[own + toxicity._PART].sum(axis=0) for own in doc]
        best, pool = {}, np.zeros(len(net.out))
        for k, (width, f) in enumerate(zip(toxicity.WIDTHS, net.filters, strict=True)):
            for c in range(toxicity.FILTERS):
                responses = [sum(vectors[s + j] @ f[j, :, c] for j in range(width)) for s in range(len(doc) - width + 1)]
                if responses:
                    place = k * toxicity.FILTERS + c
                    best[place] = int(np.argmax(responses))
                    pool[place] = max(max(responses) + net.offset[place], 0)
        d = w * (1 / (1 + np.exp(-(pool @ net.out + net.bias))) - target)
        out += d * pool
        bias += d
        for place, s in best.items():
            if pool[place] > 0:
                k, c = divmod(place, toxicity.FILTERS)
                own = d * net.out[place]
                offset[place] += own
                for j in range(toxicity.WIDTHS[k]):
                    filters[k][j, :, c] += own * vectors[s + j]
                    for slot in doc[s + j] + toxicity._PART:
                        table[slot] += own * net.filters[k][j, :, c]
    return table, filters, offset, out, bias


def test_gradient_equals_a_plain_loop(monkeypatch):
    net, rng = toxicity.Network(), np.random.default_rng(4)
    net.offset[:] = rng.normal(0, 0.1, len(net.offset))
    docs = [rng.integers(0, 60, (n, toxicity.PARTS)).astype(np.uint16) for n in (0, 1, 2, 3, 30, 7, 90, 12)]
    y, weight = np.array([0, 1, 0, 1, 1, 0, 1, 0]), rng.uniform(0.5, 2, 8)
    expected = plain_gradient(net, docs, y, weight)
    for most in (1 << 16, 20, 1):  # in one part, in some, one document each
        monkeypatch.setattr(toxicity, "MOST_WORDS", most)
        rows, values, filters, offset, out, bias = toxicity._gradient(net, docs, y, weight)
        where, summed = toxicity._summed(rows, values)
        table = np.zeros_like(net.table)
        table[where] = summed
        assert len(where) == len(set(where.tolist())) and np.allclose(table, expected[0], atol=1e-5)
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip([*filters, offset, out], [*expected[1], *expected[2:4]], strict=True))
        assert abs(bias - expected[4]) < 1e-5


def test_thresholds_equal_trying_each():
    rng = np.random.default_rng(6)
    for n in (2, 5, 40, 200):
        for _ in range(20):
            logits = rng.integers(-4, 5, n) / 2.0  # with ties
            y = rng.integers(0, 2, n)
            if len(set(y.tolist())) < 2:
                assert toxicity._threshold(logits, y) == 0
                continue

            def gain(cut):
                return (logits[y == 1] > cut).mean() - (logits[y == 0] > cut).mean()

            tried = [gain(c) for c in np.arange(-4, 5, 0.25)]
            assert gain(toxicity._threshold(logits, y)) >= max(max(tried), 0) - 1e-12 or max(tried) == 0


def test_sample_is_bounded_in_bytes_and_rows_count_once(docs, spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, y, language: seen.append((rows, y)) or toxicity.Network())
    texts = [(i, "word " * (5000 if i % 7 == 0 else 10)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    held = nbsvm.held_out(5, 0)
    usable = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5]
    for most, short_only in ((10_000, True), (10_000_000, False)):
        toxicity.fit(docs(texts + texts[:5]), labels, "toxic", held, most_bytes=most)
        rows, y = seen.pop()
        expected = [i for i in usable if not short_only or i % 7]
        assert len(rows) == len(expected) and sum(y) == sum(i % 2 for i in expected)
        assert sum(r.nbytes for r in rows) <= most


def test_count_ratios_and_scores_equal_plain_counts():
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 50, rng.integers(0, 12))) for _ in range(40)]
    y = np.where(np.arange(40) % 3 == 0, 1, -1)
    got = nbsvm.count_ratios(rows, y)
    for f in range(60):
        share = [(sum(f in r for r, s in zip(rows, y) if s == sign) + 1) / ((y == sign).sum() + 2) for sign in (1, -1)]
        assert np.isclose(got[f], np.log(share[0] / share[1]))
    model = nbsvm.train(rows, (y > 0).astype(int))
    margins = np.array([sum(float(model.weights[f]) for f in r) for r in rows])
    assert np.allclose(model.scores(margins), 1 / (1 + np.exp(-(model.slope * (margins + model.bias) + model.shift))))


def test_logistic_curve_is_the_best_of_its_kind():
    rng = np.random.default_rng(12)
    y = np.where(rng.random(80) < 0.3, 1, -1)
    margin = y * 0.7 + rng.normal(0, 1, 80)
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target, weight = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.where(y > 0, 0.5 / n1, 0.5 / n0)

    def loss(slope, shift):
        p = 1 / (1 + np.exp(-(slope * margin + shift)))
        return -(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() + 0.5e-6 * (slope**2 + shift**2)

    slope, shift = nbsvm._logistic(margin, y)
    assert all(loss(slope, shift) <= loss(slope + a, shift + b) + 1e-9 for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))


def test_the_sample_of_quality_is_bounded_in_rows_and_bytes(spark):
    from weftline.llm import nbsvm

    rows = [(7, 1, bytes([i % 256, i // 256] * 4)) for i in range(20_000)] + [(i, 0, b"x" * 1000) for i in range(100, 130)] + [(100, 0, b"x" * 1000)] * 5 + [(200, 1, b"y" * 9000)]
    made = spark.createDataFrame(rows, "doc_id long, y int, features binary")
    found = nbsvm.bounded(made, "features", sample=50, most_bytes=16_000).collect()
    assert sum(r.y == 1 for r in found) <= 50 and sum(r.y == 0 for r in found) == 8
    assert all(sum(len(r.features) for r in found if r.y == y) <= 8000 for y in (0, 1))
    assert len({tuple(r) for r in found}) == len(found)


def test_repeated_ids_do_not_multiply_what_quality_learns_from(spark):
    from weftline.llm import nbsvm

    docs = spark.range(20_001).selectExpr("5L as doc_id", "concat('word ', id) as text")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    assert nbsvm.bounded(nbsvm.labelled_sample(docs, labels, "quality", nbsvm.held_out(3, 7), 3).selectExpr("doc_id", "y", "cast(text as binary) text"), "text", 3, 1000).count() <= 3
