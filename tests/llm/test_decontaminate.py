import random
import re
from collections import Counter

import numpy as np

from weftline.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def shingled(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def similarity(a, b):
    weight = lambda s: sum(len(w.encode()) for w in s)
    low = sum(min(a[s], b[s]) * weight(s) for s in a.keys() & b.keys())
    high = sum(max(a[s], b[s]) * weight(s) for s in a.keys() | b.keys())
    return low / high if high else 0.0


def brute(docs, items, k=5, threshold=0.8):
    found = {}
    for d, text in docs:
        words = WORD.findall((text or "").translate(FOLD))
        for i, item in items:
            own = WORD.findall((item or "").translate(FOLD))
            if own and len(words) >= len(own):
                size = min(k, len(own))
                best = max(((similarity(shingled(words[s : s + len(own)], size), shingled(own, size)), -s) for s in range(len(words) - len(own) + 1)), default=(0, 0))
                if best[0] >= threshold:
                    found[(d, i)] = (-best[1], round(best[0], 9))
    return found


def test_equals_brute_force(docs, spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 15, 30, 50])))) for i in range(12)] + [(90, ""), (91, None), (92, "solo")]
    rows = [(1000, None), (1001, ""), (1002, "solo"), (1003, "v1 " * 4000)]
    for d in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        if d % 2:
            passage = (items[rng.randrange(12)][1]).split()
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "edited"
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() for w in passage[rng.randrange(2) :]]
        rows.append((d, " ".join(text)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.window_start, round(r.similarity, 9)) for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert got == brute(rows, items)
    kept = {r.doc_id for r in decontaminate.clean(docs(rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.clean(docs(rows), bench).columns == docs(rows).columns


def test_blocks_of_items_give_the_same(docs, spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(9)], "item_id long, text string")
    rows = docs([(i, "before " + " ".join(f"w{i}x{j}" for j in range(20)) + " after") for i in range(9)])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 8000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, items).collect()} == {(i, i) for i in range(9)}
    assert decontaminate.contaminated(rows, items.limit(0)).collect() == []
    assert decontaminate.contaminated(rows.limit(0), items).collect() == []


def test_index_finds_all_within_radius():
    index = decontaminate.Items([1], [" ".join(f"a{i}" for i in range(30))], 5)
    rng = np.random.default_rng(2)
    for distance in range(decontaminate.RADIUS + 3):
        flips = [sum(1 << int(b) for b in rng.choice(64, distance, replace=False)) for _ in range(200)]
        prints = index.prints[0] ^ np.array(flips, dtype=np.uint64)
        assert len(index.near(prints, 30)[0]) == (200 if distance <= decontaminate.RADIUS else 0)


def test_documents_shorter_than_the_item_are_compared_whole(docs, spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate([15, 50, 59, 4, 6])]
    rows = [(10 * i + cut, " ".join(item.split()[cut:] if i % 2 else item.split()[: len(item.split()) - cut])) for i, item in items for cut in range(6)]
    rows += [(100, " ".join(items[1][1].split()[:20])), (101, "w1x0"), (102, "")]
    expected = {}
    for d, text in rows:
        words = text.split()
        for i, item in items:
            own = item.split()
            size, n = min(5, len(own)), min(len(own), len(words))
            best = max(((similarity(shingled(words[s : s + n], size), shingled(own, size)), -s, n) for s in range(len(words) - n + 1)), default=(0, 0, 0))
            if best[0] >= 0.8:
                expected[(d, i)] = (-best[1], best[2], round(best[0], 9))
    assert {11, 12, 21, 22} <= {d for d, _ in expected}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.window_start, r.window_words, round(r.similarity, 9)) for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert got == expected
    assert {r.doc_id for r in decontaminate.clean(docs(rows), bench).collect()} == {d for d, _ in rows} - {d for d, _ in expected}


def test_structure_is_as_small_as_estimated():
    import pickle

    rng = random.Random(8)
    for n in (2, 20, 60):
        texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for _ in range(2000)]
        size = len(pickle.dumps(decontaminate.Items(list(range(2000)), texts, 5)))
        assert size <= sum(decontaminate.ITEM_BYTES + decontaminate.TEXT_BYTES * len(t) for t in texts)


def test_long_texts_are_voted_on_in_strides(monkeypatch):
    words = np.random.default_rng(1).integers(1, 2**63, 500, dtype=np.uint64)
    starts = np.array([0, 1, 2, 90, 91, 300, 301, 470])
    whole = decontaminate._prints(words, starts, 30)
    monkeypatch.setattr(decontaminate, "STRIDE", 7)
    assert (decontaminate._prints(words, starts, 30) == whole).all()
    assert (whole == [decontaminate._vote(decontaminate._ones(words[s : s + 30])[-1:], 30)[0] for s in starts]).all()


def test_recall_at_the_threshold(docs, spark):
    """Edited passages by their similarity: the Hamming radius loses under a tenth of them in each band."""
    rng = random.Random(11)
    vocabulary = [f"{rng.choice('bcdfgt')}{rng.randrange(2000)}" for _ in range(900)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25, 60)))) for i in range(120)]
    rows, expected = [], {}
    for i, item in items:
        for e in range(1, 6):
            words = item.split()
            for j in rng.sample(range(len(words)), e) if e % 2 else range(len(words) - e, len(words)):
                words[j] = f"new{rng.randrange(10**6)}"
            s = similarity(shingled(words, 5), shingled(item.split(), 5))
            if s >= 0.8:
                expected[(len(rows), i)] = s
            rows.append((len(rows), " ".join(["before", "this", *words, "and", "after"])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        own = {pair for pair, s in expected.items() if low <= s < high}
        assert len(own) > 20 and len(own & found) >= 0.9 * len(own)
