"""Images held in table columns: Netpbm and BMP to numpy, area resizing, NPY tiles, difference hashes.

Resizing averages areas exactly: the integral image (prefix sums in both
directions), interpolated linearly at fractional places, gives the sum over any
rectangle from its four corners.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import arrow_map

TILE = 32
BATCH_BYTES = 4 << 20
FAULTS = (ValueError, IndexError, OverflowError, TypeError, struct.error)
_HEADER = re.compile(rb"P([1-6])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)")
_NUMBER = re.compile(rb"(?:\s+|#[^\n]*\n)+(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """8-bit gray samples (height, width) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit gray samples as an uncompressed BMP with a gray palette."""
    height, width = samples.shape
    rows = np.pad(samples.astype(np.uint8)[::-1], ((0, 0), (0, -width % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", at + rows.size, 0, 0, at, 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0) + palette.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The samples of ``read``, as they are stored."""
    return read(data)[0]


def read(data: bytes) -> tuple[np.ndarray, int, bool]:
    """A Netpbm (P1-P7) or uncompressed BMP (1, 4, 8, 24, 32 bits) image: (height, width) or (height, width, 3) samples,
    their largest possible value, and whether it stands for black (bitmaps).

    Alpha channels are left out. ValueError for anything else, for truncated or empty images and for samples beyond the largest value.
    """
    try:
        samples, top, black = _read_bmp(data) if data[:2] == b"BM" else _read_pam(data) if data[:2] == b"P7" else _read_pnm(data)
    except FAULTS as error:
        raise ValueError(str(error) or type(error).__name__) from error
    if not samples.size:
        raise ValueError("an image without samples")
    if samples.max() > top:
        raise ValueError("a sample beyond the largest value")
    return samples, top, black


def _raw(data: bytes, at: int, count: int, top: int) -> np.ndarray:
    kind = np.dtype(">u2" if top > 255 else np.uint8)
    if len(data) < at + count * kind.itemsize:
        raise ValueError("truncated")
    return np.frombuffer(data, kind, count, at)


def _top(number: int) -> int:
    if not 0 < number < 65536:
        raise ValueError("a largest sample value out of range")
    return number


def _read_pnm(data: bytes) -> tuple[np.ndarray, int, bool]:
    match = _HEADER.match(data)
    if not match:
        raise ValueError("neither Netpbm nor BMP")
    kind, width, height = (int(x) for x in match.groups())
    at, top = match.end(), 1
    if kind not in (1, 4):
        number = _NUMBER.match(data, at)
        if not number:
            raise ValueError("no largest sample value")
        at, top = number.end(), _top(int(number[1]))
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = height * width * (3 if kind in (3, 6) else 1)
    if kind == 1:
        values = np.frombuffer(re.sub(rb"#[^\n]*\n|\s", b"", data[at:])[:count], np.uint8) - np.uint8(48)
    elif kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*\n", b"", data[at:]).split()[:count], dtype=np.int64)
        if len(values) and values.min() < 0:
            raise ValueError("a negative sample")
    elif kind == 4:
        stride = -(-width // 8)
        values = np.unpackbits(_raw(data, at + 1, height * stride, 1).reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        values = _raw(data, at + 1, count, top)
    if len(values) != count:
        raise ValueError("truncated")
    if count and values.max() > top:
        raise ValueError("a sample beyond the largest value")
    return (values.astype(np.uint16 if top > 255 else np.uint8) if kind in (2, 3) else values).reshape(shape), top, kind in (1, 4)


def _read_pam(data: bytes) -> tuple[np.ndarray, int, bool]:
    head, end, _ = data.partition(b"ENDHDR\n")
    fields = dict(line.split(None, 1) for line in head.splitlines()[1:] if line.strip() and not line.startswith(b"#") and len(line.split(None, 1)) == 2)
    if not end or not {b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"} <= set(fields):
        raise ValueError("an incomplete P7 header")
    width, height, depth, top = (int(fields[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    if depth not in (1, 2, 3, 4):
        raise ValueError("a P7 image of other than 1 to 4 channels")
    samples = _raw(data, len(head) + len(end), height * width * depth, _top(top)).reshape(height, width, depth)
    return (samples[:, :, 0] if depth < 3 else samples[:, :, :3]), top, False


def _read_bmp(data: bytes) -> tuple[np.ndarray, int, bool]:
    if len(data) < 54:
        raise ValueError("truncated")
    at, size = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or bits not in (1, 4, 8, 24, 32) or width <= 0:
        raise ValueError("not an uncompressed BMP of 1, 4, 8, 24 or 32 bits")
    up, height = height > 0, abs(height)
    stride = -(-width * bits // 32) * 4
    rows = _raw(data, at, stride * height, 255).reshape(height, stride)
    rows = rows[::-1] if up else rows
    if bits > 8:
        return rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1], 255, False
    if bits < 8:
        unpacked = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = (unpacked * (1 << np.arange(bits)[::-1]).astype(np.uint8)).sum(axis=2, dtype=np.uint8)
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    out = palette[rows[:, :width]]
    return (out[:, :, 0] if (palette == palette[:, :1]).all() else out), 255, False


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Exact area averages of a gray image on a height x width grid, as float64."""
    sums = np.zeros((samples.shape[0] + 1, samples.shape[1] + 1))
    np.cumsum(np.cumsum(samples, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def along(values: np.ndarray, n: int) -> np.ndarray:
        place = np.linspace(0, len(values) - 1, n + 1)
        low = np.minimum(place.astype(np.int64), len(values) - 2)
        part = (place - low)[:, None]
        return values[low] * (1 - part) + values[low + 1] * part

    corner = along(along(sums, height).T, width).T
    area = samples.shape[0] * samples.shape[1] / (height * width)
    return (corner[1:, 1:] - corner[1:, :-1] - corner[:-1, 1:] + corner[:-1, :-1]) / area


def gray(samples: np.ndarray, top: int = 255, black: bool = False) -> np.ndarray:
    """Brightness from 0 to 255: the mean of the channels, scaled by the largest value."""
    mean = samples if samples.ndim == 2 else samples.mean(axis=2)
    if top != 255:
        mean = mean * (255 / top)
    return 255 - mean if black else mean


def difference_hash(brightness: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 resized image is brighter than the one to its right."""
    small = np.round(area_resize(brightness, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] > small[:, 1:]).tobytes(), "big")


def npy_tile(brightness: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side 8-bit samples, as an NPY file."""
    out = io.BytesIO()
    small = np.clip(np.rint(np.round(area_resize(brightness, side, side), 6)), 0, 255)
    np.save(out, np.ascontiguousarray(small, dtype=np.uint8))
    return out.getvalue()


def _parts(column: pa.Array):
    """Slices (start, length) of a binary column of about BATCH_BYTES."""
    at, held = 0, 0
    for i in range(len(column)):
        held += len(column[i].as_buffer()) if column[i].is_valid else 0
        if held > BATCH_BYTES:
            yield at, i + 1 - at
            at, held = i + 1, 0
    if at < len(column):
        yield at, len(column) - at


def store_texts(docs: DataFrame, width: int = 64, form: str = "pgm") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of ``width``, as gray image rows."""
    encoder = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"")
            for at, n in _parts(texts):
                raw = texts.slice(at, n).to_pylist()
                media = [encoder(np.frombuffer(t + bytes(-len(t) % width or (0 if t else width)), np.uint8).reshape(-1, width)) for t in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(arrow_map, run, "doc_id long, n_bytes long, media binary")


def tiles(media: DataFrame, side: int = TILE) -> DataFrame:
    """``media`` (a binary column media; others stay) with tile (NPY bytes), dhash (16 hex digits) and media_error.

    A null medium has neither tile nor hash; one that cannot be decoded has the reason in media_error.
    Columns of these names that exist already are replaced.
    """
    names = ["tile", "dhash", "media_error"]
    media = media.drop(*names)
    at_column = media.columns.index("media")
    columns = media.columns

    def one(data: bytes | None) -> tuple[bytes | None, str | None, str | None]:
        if data is None:
            return None, None, None
        try:
            brightness = gray(*read(data))
            return npy_tile(brightness, side), f"{difference_hash(brightness):016x}", None
        except ValueError as error:
            return None, None, str(error)

    def run(batches):
        for batch in batches:
            for at, n in _parts(batch.column(at_column)):
                part = batch.slice(at, n)
                made = list(zip(*map(one, part.column(at_column).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(m, t) for m, t in zip(made, (pa.binary(), pa.string(), pa.string()), strict=True))], [*columns, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields), "tile binary, dhash string, media_error string"])
    return media.transform(arrow_map, run, schema)


def digests(docs: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each row.

    The payload is read back from the stored image's samples. ``feature`` is the
    difference hash and the first 16 hex digits of the tile's SHA-256. A null
    text counts as empty, whose payload is ``width`` zeros. Other columns play no part.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for batch in batches:
            for at, n in _parts(batch.column(2)):
                rows = []
                for doc_id, size, media, tile, dhash in zip(*(batch.column(c).slice(at, n).to_pylist() for c in range(5)), strict=True):
                    payload = decode(media).tobytes()
                    rows.append((doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{dhash}:{hashlib.sha256(tile).hexdigest()[:16]}"))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return tiles(store_texts(docs, width)).select("doc_id", "n_bytes", "media", "tile", "dhash").transform(arrow_map, run, schema)
