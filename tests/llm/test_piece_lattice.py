import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import piece_lattice


def tiny():
    """Pieces over a and b with a space piece, and byte pieces for everything else."""
    pieces = [(b" ", -1.5), (b"a", -2.0), (b"b", -2.5), (b"ab", -1.0), (b" a", -1.2), (b"ba", -3.0), (b"aba", -2.2)]
    return piece_lattice.vocabulary(pieces, {b: 100 + b for b in range(256)}, list(range(7)), 400), {p: (i, s) for i, (p, s) in enumerate(pieces)}


def segmentations(text, known):
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, len(text) + 1):
        if text[:n] in known:
            i, s = known[text[:n]]
            out += [((i, *rest), s + t) for rest, t in segmentations(text[n:], known)]
    return out


def test_samples_follow_the_exact_posterior():
    v, known = tiny()
    text, n = "abab aba", 20000
    ways = segmentations(b" " + text.encode(), known)
    total = sum(math.exp(s) for _, s in ways)
    expected = {w: math.exp(s) / total for w, s in ways}
    seen = Counter()
    for _, out, first in piece_lattice.encode_batch(pa.array([text] * n), np.arange(n).astype(np.uint64), v, 1):
        seen.update(tuple(out[first[i] : first[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(expected)
    for way, p in expected.items():
        assert abs(seen[way] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


TEXTS = [None, "", " ", "  two  spaces ", "line\nbreak\r\n\ttab", "▁literal ▁▁ marks", "naïve Ünï 日本語 \U0001f600\U0001f600", "x" * 5000, "the quick brown fox " * 2000, "\u0001\u0000end", "é", "a▁b c"]


def test_round_trip_and_reproducibility(docs):
    rows = docs(list(enumerate(TEXTS)) + [(None, "no key"), (3, TEXTS[3])])
    encoded = piece_lattice.encode(rows)
    back = piece_lattice.decode(encoded).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter([(i, t or "") for i, t in enumerate(TEXTS)] + [(None, "no key"), (3, TEXTS[3])])
    one = {(r.doc_id, tuple(r.pieces)) for r in encoded.collect()}
    assert one == {(r.doc_id, tuple(r.pieces)) for r in piece_lattice.encode(rows.repartition(7)).collect()}
    assert one != {(r.doc_id, tuple(r.pieces)) for r in piece_lattice.encode(rows, seed=2).collect()}
    digests = piece_lattice.digests(rows).collect()
    assert all(r.lossless for r in digests)
    assert {(r.doc_id, r.n_pieces) for r in digests} == {(d, len(p)) for d, p in one}
    assert piece_lattice.encode(rows.limit(0)).collect() == []
    assert piece_lattice.decode(encoded.withColumn("pieces", F.lit(None).cast("array<int>"))).where("text <> ''").count() == 0


def test_pieces_belong_to_the_model(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.DEFAULT_MODEL)
    text = "The quick brown fox jumps over the lazy dog"
    (row,) = piece_lattice.encode(docs([(1, text)])).collect()
    assert model.decode(list(row.pieces)) == text


def test_stretches_are_equal_by_bytes(docs, monkeypatch):
    """Strings that a polynomial hash confuses, and stretches that a broken hash takes for equal, come back as they were."""
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = docs([(1, word), (2, word.translate(str.maketrans("ab", "ba")))])
    assert all(r.lossless for r in piece_lattice.digests(rows).collect())
    v, _ = tiny()
    monkeypatch.setattr(piece_lattice, "word_hashes", lambda data, starts, ends, fold: (ends - starts).astype(np.uint64) // 3)
    texts = ["ab ba ab", "aba aba", "bab", "ab" * 200, "ba" * 200]
    for _, out, first in piece_lattice.encode_batch(pa.array(texts), np.arange(5).astype(np.uint64), v, 1):
        back, begin = piece_lattice.decode_ids(out.astype(np.int64), first, v)
        assert [back[begin[i] : begin[i + 1]].tobytes().decode() for i in range(5)] == texts


def test_long_stretches_equal_short_ones(monkeypatch):
    """Both ways through the lattice draw the same pieces, also where a long stretch is cut into blocks; and lengths cost alike."""
    import random
    import time

    v = piece_lattice.load(piece_lattice.DEFAULT_MODEL)
    draw = random.Random(5)
    latin = "".join(draw.choice("etaoinshrdlu") for _ in range(4000))
    chinese = "".join(draw.choice("的一是不了人我在有他这中大来上国") for _ in range(2000))
    texts = ["plain words", latin, "", latin[:511], chinese, latin[:512], latin, chinese[:171], None, "\U0001f600" * 300 + "é▁" * 200]

    def pieces(block, long):
        monkeypatch.setattr(piece_lattice, "BLOCK", block)
        monkeypatch.setattr(piece_lattice, "LONG", long)
        return [out.tolist() for _, out, _ in piece_lattice.encode_batch(pa.array(texts), np.arange(len(texts)).astype(np.uint64), v, 1)]

    one = pieces(1 << 14, 1 << 40)
    assert one == pieces(1 << 14, 512) == pieces(97, 512) == pieces(40, 2)
    monkeypatch.undo()
    start = time.process_time()
    ((_, out, _),) = piece_lattice.encode_batch(pa.array([chinese * 330]), np.zeros(1, np.uint64), v, 1)
    assert time.process_time() - start < 20
    back, _ = piece_lattice.decode_ids(out.astype(np.int64), np.array([0, len(out)]), v)
    assert back.tobytes().decode() == chinese * 330
