import random
import re

import numpy as np
import pytest

from weftline.llm import near_dup, setsketch

WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d if d is not None else -1), len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "lost row without an id"), (5000, None), (5001, ""), (5002, " \n\t"), (5003, "One"), (5004, "one"), (5005, "a b"), (5006, "A  B"), (5007, "b a"), (5008, "x " * 3000)]
    for i in range(n):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 40, 120]))]
        rows.append((10 * i, " ".join(base)))
        for c in range(rng.randrange(4)):
            copy = base[:]
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 * i + c + 1, " ".join(copy).upper() if c == 1 else " ".join(copy)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_equals_brute_force(docs, k, percent):
    rows = corpus(k)
    got = near_dup.near_duplicates(docs(rows), k=k, percent=percent).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None and r.component_id is not None)


def test_chain_and_large_bucket(docs):
    """A large group around a base whose members are far from each other: links run over several members."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 320):
        copy = base[:]
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_dup.near_duplicates(docs(rows), k=3, percent=85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)


def test_repeated_rows_and_empty_table(docs, spark):
    rows = [(7, "the same text here"), (7, "the same text here"), (3, "the same text here"), (9, "another text of this table")]
    got = near_dup.near_duplicates(docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    assert near_dup.near_duplicates(docs(rows).limit(0)).collect() == []


def flipped(n):
    """Words of 2**n letters a and b that every polynomial hash modulo 2**64 takes for equal from n = 11 on."""
    swap = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(n):
        word += word.translate(swap)
    return word, word.translate(swap)


def test_ids_that_are_null_or_repeated_between_near_copies(docs):
    base = [f"w{i}" for i in range(60)]
    changed = lambda at: " ".join("new" if i in at else w for i, w in enumerate(base))
    tail = " ".join(f"t{i}" for i in range(60))
    near_tail = tail.replace("t3 ", "u3 ")
    rows = [(1, changed({0, 1, 2})), (None, " ".join(base)), (2, changed({57, 58, 59}))]
    rows += [(70, "first text of seventy " * 9 + "end"), (70, tail), (90, "first text of seventy " * 9 + "end"), (30, near_tail), (30, near_tail), (30, near_tail)]
    rows += [(None, "nobody owns this text"), (None, "nobody owns this text"), (None, None)]
    got = near_dup.near_duplicates(docs(rows), k=3, percent=85).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got if r.component_id is not None) == [x for x in brute(rows, 3, 85) if x[2] is not None]
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1} and len(got) == len(rows)


def test_words_that_polynomial_hashes_confuse(docs):
    a, b = flipped(11)
    c, d = flipped(7)
    rows = [(1, f"{a} {c}"), (2, f"{b} {c}"), (3, f"{a} {d}"), (4, f"{a.upper()} {c}")]
    got = near_dup.near_duplicates(docs(rows), k=1, percent=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 1)]


@pytest.mark.parametrize("block", [(7, 9), near_dup.BLOCK])
def test_loose_bucket_in_small_blocks(docs, monkeypatch, block):
    """Many groups whose bases resemble each other below the threshold share buckets: several components, several blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "FAN", 5)
    rng = random.Random(3)
    root = [f"b{i}" for i in range(200)]
    rows = []
    for group in range(12):
        base = root[:]
        for _ in range(9):
            base[rng.randrange(200)] = f"g{group}x{rng.randrange(999)}"
        for _ in range(8):
            copy = base[:]
            copy[rng.randrange(200)] = f"e{rng.randrange(999)}"
            rows.append((len(rows), " ".join(copy)))
    got = near_dup.near_duplicates(docs(rows), k=3, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 80)
    assert len({r.component_id for r in got}) > 1


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in (300, 5))
    both = np.unique(np.concatenate([a, b]))
    first = np.cumsum([0, len(a), len(b), len(both)])
    r = setsketch.sketch(np.concatenate([a, b, both]), first)
    assert (setsketch.merge(r[0], r[1]) == r[2]).all()
    for target in (0.5, 0.85):
        shared = rng.integers(1, 2**63, round(2000 * target / (1 + target)), dtype=np.uint64)
        left, right = (np.concatenate([shared, rng.integers(1, 2**63, 1000 - len(shared), dtype=np.uint64)]) for _ in range(2))
        r = setsketch.sketch(np.concatenate([left, right]), np.array([0, 1000, 2000]))
        got = setsketch.jaccard(r[:1], r[1:], np.array([1000]), np.array([1000]))[0]
        assert abs(got - target) < 0.15
    for similarity in (0.8, 0.85, 0.9):
        rows = setsketch.band_rows(similarity)
        assert (1 - similarity**rows) ** (setsketch.REGISTERS // rows) < 1e-6
