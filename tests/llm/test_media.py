import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from weftline.llm import media

TEXTS = [None, "", "a", "b" * 64, "c" * 65, "naïve 日本 \U0001f600", "long " * 30000, "\u0000\u0001"]


def resized(a, h, w):
    """Area averages by repeating every sample."""
    rows = np.arange(h * a.shape[0]) // h
    out = np.zeros((h, w))
    for i in range(h):
        for j in range(w):
            y = rows[i * a.shape[0] : (i + 1) * a.shape[0]]
            x = (np.arange(w * a.shape[1]) // w)[j * a.shape[1] : (j + 1) * a.shape[1]]
            height, width = np.bincount(y, minlength=a.shape[0]), np.bincount(x, minlength=a.shape[1])
            out[i, j] = height @ a @ width / (a.shape[0] * a.shape[1])
    return np.round(out, 6)


def brute_feature(a):
    small = resized(a.astype(float), 8, 9)
    bits = "".join("1" if small[i, j] > small[i, j + 1] else "0" for i in range(8) for j in range(8))
    out = io.BytesIO()
    np.save(out, np.rint(resized(a.astype(float), 32, 32)).astype(np.uint8))
    return f"{int(bits, 2):016x}:{hashlib.sha256(out.getvalue()).hexdigest()[:16]}"


def test_digests_equal_brute_force(docs):
    rows = list(enumerate(TEXTS)) + [(2, "a"), (None, "a")]
    got = media.digests(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (TEXTS[r.doc_id] if r.doc_id is not None else "a") or ""
        raw = raw.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.feature == brute_feature(np.frombuffer(payload, np.uint8).reshape(-1, 64))
    assert len({r.feature for r in got if r.doc_id in (None, 2)}) == 1
    assert media.digests(docs(rows).limit(0)).collect() == []


def test_area_resize_equals_oversampling():
    rng = np.random.default_rng(3)
    for shape, (h, w) in (((7, 5), (3, 4)), ((1, 64), (8, 9)), ((12, 12), (12, 12)), ((2, 3), (5, 7))):
        a = rng.integers(0, 256, shape)
        big = np.kron(a, np.ones((h, w)))
        plain = big.reshape(h, shape[0], w, shape[1]).mean(axis=(1, 3))
        assert np.allclose(media.area_resize(a, h, w), plain)


def test_formats():
    rng = np.random.default_rng(5)
    gray, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(gray)) == gray).all()
    assert (media.decode(media.encode_bmp(gray)) == gray).all()
    assert (media.decode(b"P6 3 4 255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P3\n# note\n3 4\n255\n" + b" ".join(b"%d" % v for v in colour.ravel())) == colour).all()
    assert (media.decode(b"P2 7 5 255 " + b" ".join(b"%d" % v for v in gray.ravel())) == gray).all()
    assert media.decode(b"P1 3 2\n101\n0 1 0").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P4 9 2\n" + bytes([0b10100000, 0b10000000, 0, 0])).tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 1], [0] * 9]
    wide = rng.integers(0, 65536, (2, 3))
    assert (media.decode(b"P5 3 2 65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    for broken in (b"", b"GIF89a", b"P5 7 5 255\nshort", b"BM", b"P5 7"):
        with pytest.raises(ValueError):
            media.decode(broken)


def test_more_formats_and_faults():
    pam = b"P7\nWIDTH 2\nHEIGHT 2\nDEPTH %d\nMAXVAL 255\n# note\nTUPLTYPE X\nENDHDR\n"
    assert media.decode(pam % 2 + bytes([9, 255, 8, 0, 7, 1, 6, 2])).tolist() == [[9, 8], [7, 6]]
    assert media.decode(pam % 4 + bytes(range(16))).tolist() == [[[0, 1, 2], [4, 5, 6]], [[8, 9, 10], [12, 13, 14]]]
    palette = b"".join(bytes([i, i, i, 0]) for i in range(0, 160, 10))

    def bmp(bits, width, height, colours, rows, packing=0):
        at = 54 + len(palette)
        return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + len(rows), 0, 0, at, 40, width, height, 1, bits, packing, len(rows), 0, 0, colours, 0) + palette + rows

    assert media.decode(bmp(4, 3, -1, 16, bytes([0x12, 0xF0, 0, 0]))).tolist() == [[10, 20, 150]]
    assert media.decode(bmp(1, 10, -1, 2, bytes([0b10100000, 0b01000000, 0, 0]))).tolist() == [[10, 0, 10, 0, 0, 0, 0, 0, 0, 10]]
    broken = [b"P1 2 2\n!!!!", bmp(4, 3, -1, 1, bytes([0x12, 0xF0, 0, 0])), bmp(8, 4, 1, 2, bytes([0, 1, 2, 200])), bmp(24, 3, 1, 0, b"short"), bmp(8, 2, 1, 4, bytes(4), 1)]
    broken += [b"P5 0 0 255\n", b"P2 2 1 15 3 77", b"P2 2 1 15 3 x", b"P2 2 1 15 -3 4", b"P5 1 1 99999\nxx", b"P7\nWIDTH 2\nENDHDR\n", pam % 9, b"BM" + bytes(60), b"P4 9 2\n\x00", b"P6 99999999 99999999 255\nx"]
    for data in broken:
        with pytest.raises(ValueError):
            media.read(data)


def test_brightness_follows_the_largest_value(spark):
    ramp = np.tile(np.arange(0, 65536, 1024), (32, 1))
    wide = b"P5 64 32 65535\n" + ramp.astype(">u2").tobytes()
    low = b"P2 2 1 15 " + b"0 15"
    bitmap, black = b"P1 2 1\n10", b"P4 8 1\n" + bytes([0xF0])
    rows = [(1, wide), (2, low), (3, bitmap), (4, black), (5, b"P1 2 2\n!!!!"), (6, b"BM" + bytes(60))]
    got = {r.k: r for r in media.tiles(spark.createDataFrame(rows, "k long, media binary")).collect()}
    tile = {k: np.load(io.BytesIO(bytes(r.tile))) for k, r in got.items() if r.tile}
    assert (np.diff(tile[1][0].astype(int)) > 0).all() and (tile[1][0, 0], tile[1][0, -1]) == (2, 249)
    assert (tile[2][0, 0], tile[2][0, -1]) == (0, 255)
    assert (tile[3][0, 0], tile[3][0, -1]) == (0, 255) and (tile[4][0, 0], tile[4][0, -1]) == (0, 255)
    assert got[5].media_error and got[6].media_error and got[5].tile is None


def test_tiles_of_a_column(spark):
    ramp = np.tile(np.arange(0, 256, 4, dtype=np.uint8), (64, 1))
    rows = [(1, media.encode_pgm(ramp)), (2, None), (3, b"no image"), (4, media.encode_bmp(ramp[:, ::-1]))]
    frame = spark.createDataFrame(rows, "k long, media binary").selectExpr("*", "'old' AS tile")
    got = {r.k: r for r in media.tiles(frame).collect()}
    assert np.load(io.BytesIO(bytes(got[1].tile))).shape == (32, 32)
    assert (got[1].dhash, got[4].dhash) == ("0" * 16, "f" * 16)
    assert (got[2].tile, got[2].dhash, got[2].media_error) == (None, None, None)
    assert got[3].tile is None and "neither" in got[3].media_error
