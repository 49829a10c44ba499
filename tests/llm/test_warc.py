import gzip
import hashlib
import io
import random

import pytest

from weftline.llm import warc


def expected(rows):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page is not None:
            first[body] = min(first.get(body, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = body in first and page != first[body]
        out.append((page if page is not None else -1, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a", "x" * 99), (2, "http://b", "x" * 99), (5, "http://c", "é" * 50), (4, None, "é" * 50), (9, "http://d\r\nEvil: 1", "é" * 50), (6, "http://e", None),
    (7, "http://f", ""), (None, "http://g", "é" * 50), (8, "http://h", "WARC/1.1\r\n\r\n\x1f\x8b\x08 not a member " * 20), (11, "http://i", "y" * 300000), (12, "http://j", "solo page"), (12, "http://j", "solo page"),
]


@pytest.mark.parametrize("split", [37, 1000, 1 << 24])
def test_round_trip_equals_brute_force(spark, split):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'clash' AS digest", "'clash' AS kind", "'clash' AS payload")
    got = warc.round_trip(pages, split_bytes=split).collect()
    assert sorted(((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_every_cut_gives_every_record_once():
    noise = bytes(range(256)) * 3 + warc.MAGIC + b"junk" + gzip.compress(b"no record")
    members = [warc.format_record("response", f"urn:page:{i}", "http://x", noise * (i % 3), {}) for i in range(6)]
    data = b"".join(members)
    for step in (1, 7, 50, 333, len(data)):
        if step == 1:
            ranges = [(i, i + 1) for i in range(0, len(data), 1)][:: max(1, len(data) // 400)]
            starts = [r.start for a, b in ranges for r in warc.read_range(io.BytesIO(data), a, b)]
            assert set(starts) <= {sum(map(len, members[:i])) for i in range(6)}
            continue
        found = [r for a in range(0, len(data), step) for r in warc.read_range(io.BytesIO(data), a, min(a + step, len(data)))]
        assert [r.headers["warc-record-id"] for r in found] == [f"<urn:page:{i}>" for i in range(6)]
        assert [r.block for r in found] == [noise * (i % 3) for i in range(6)]


def test_truncated_archives_lose_only_the_last_record():
    members = [warc.format_record("response", f"urn:page:{i}", "http://x", b"body" * 50, {}) for i in range(3)]
    data = b"".join(members)[:-5]
    assert len(list(warc.read_range(io.BytesIO(data), 0, len(data)))) == 2


def test_long_urls_are_read_back(spark):
    url = "data:" + "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=500_000))
    rows = [(1, url, "z" * 200), (2, "http://b", "z" * 200), (3, url[:110_000], None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    data = b"".join(warc.format_record("response", f"urn:page:{i}", u, b"body", {}) for i, u, _ in rows)
    assert [r.headers["warc-target-uri"] for r in warc.read_range(io.BytesIO(data), 0, len(data))] == [u for _, u, _ in rows]


def test_lost_records_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(warc, "_member", lambda source, start: None)
    with pytest.raises(ValueError, match="1 records were written, but 0 read"):
        warc.round_trip(spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")).collect()
