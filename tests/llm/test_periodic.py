import hashlib
import random
import zlib

import numpy as np
import pytest

from weftline.llm import periodic


def brute_runs(words):
    """Every run by its definition: the smallest period of each stretch, stretch by stretch."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            part = words[start : start + length]
            smaller = any(part[d:] == part[:-d] for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                found.append((start, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng, n, letters):
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):  # plant repeats, some within each other
        at, q, times = rng.randint(0, n), rng.randint(1, 7), rng.randint(2, 9)
        words[at:at] = (words[at : at + q] or ["x"]) * times
    return words


TEXTS = [
    None, "", " \t\n", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " + "a b c " * 4 + "a y", "a a a a a a b " * 5, "é é é\u00a0é é é é é é", "A a A a A a A a",
    "word " * 3000, "p q r s t u v w x y z " * 90 + "end", " ".join(str(i) for i in range(4000)), "x\x0by\x0cx y\rx y\nx y x y",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return TEXTS + [" ".join(some_words(rng, rng.randint(0, 60), letters)) for letters in ("ab", "abc", "abcdefgh") for _ in range(60)]


@pytest.mark.parametrize(("long_bytes", "range_work"), [(1 << 16, 1 << 28), (40, 30), (-1, 1 << 28)])
def test_runs_equal_brute_force(docs, texts, long_bytes, range_work):
    rows = list(enumerate(texts)) + [(3, "a a a a a a"), (None, "a b a b a b a b")]
    got = periodic.find_runs(docs(rows).withColumnRenamed("score", "runs"), long_bytes=long_bytes, range_work=range_work)
    assert got.columns.count("runs") == 1 and "component" in got.columns
    got = got.collect()
    expected = []
    for key, text in rows:
        words = (text or "").encode().split()
        runs = brute_runs(words) if len(words) < 900 else periodic.scan(periodic.numbered(words, 0), np.array([0, len(words)]))[:, 1:].tolist()
        expected.append((str(key), [tuple(r) for r in runs], brute_collapse(words, [tuple(r) for r in runs]).decode()))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(expected)


def test_long_texts_have_the_known_runs():
    words = (b"word " * 3000).split()
    assert periodic.scan(periodic.numbered(words, 0), np.array([0, 3000])).tolist() == [[0, 0, 3000, 1]]
    words = (b"p q r s t u v w x y z " * 90 + b"end").split()
    assert periodic.scan(periodic.numbered(words, 0), np.array([0, len(words)])).tolist() == [[0, 0, 990, 11]]


def test_digests_follow_the_contract(docs, texts):
    rows = list(enumerate(texts)) + [(2**62, "a b c d e f g h i j"), (-7, "k l m n o p q")]
    got = {r.doc_id: r for r in periodic.digests(docs(rows)).collect()}
    planted = 0
    for key, text in rows:
        words = (text or "").encode().split()
        if len(words) >= 900:
            continue
        h, n = zlib.crc32(str(key).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, row = brute_runs(words), got[key]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *(best or (None,) * 3))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapse(words, runs)).hexdigest()
    assert planted > 5


def test_empty_table_and_null_doc_id(docs):
    assert periodic.digests(docs([(1, "x")]).limit(0)).collect() == []
    assert [r.n_runs for r in periodic.digests(docs([(None, "a a a a a a"), (None, None)])).orderBy("n_runs").collect()] == [0, 1]
