"""WARC archives: a writer of gzip members, and a reader that splits files at any byte.

A reading task is given a byte range. It looks for the gzip magic bytes in it,
takes each find for a candidate and accepts it only if decompressing from there
gives a WARC record header (version line, type, target or length, blank line),
however long that is: a url of any length is written whole and read back.
A task owns the records that start inside its range and reads past its end to
finish the last one, so that the ranges of a file give every record once,
wherever they are cut. Magic bytes inside compressed data fail validation, or
lie before the end of the record read last and are skipped. A round trip
compares the number of records read with the number written.

Archive files go to the cluster's shared folder through pyarrow's file systems.
Each task writes under a name of its own attempt, and only the names that
successful tasks report are ever read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import arrow_map, materialize, session_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 16 << 20
MOST_TASKS = 100_000
STEP_BYTES = 1 << 16
DEDUP_FROM = 100


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@dataclass
class Record:
    """A record as read: its header fields (lower-cased names), its block, and where its member starts and ends."""

    headers: dict[str, str]
    block: bytes
    start: int
    end: int


def format_record(kind: str, record_id: str, target: str, block: bytes, more: dict[str, str]) -> bytes:
    """One gzip member with one WARC/1.1 record. Header values have control characters taken out."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": target, **more, "Content-Length": str(len(block))}
    head = "".join(f"{k}: {''.join(c for c in v if ord(c) >= 32)}\r\n" for k, v in fields.items())
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def _parse_header(raw: bytes) -> dict[str, str] | None:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    return fields if {"warc-type", "warc-record-id"} <= set(fields) and fields.get("content-length", "").isdigit() else None


class _Bytes:
    """A file read forwards in steps, from any place."""

    def __init__(self, file, start: int) -> None:
        self.file, self.at, self.held = file, start, bytearray()

    def drop_to(self, at: int) -> None:
        del self.held[: at - self.at]
        self.at = at

    def at_least(self, n: int) -> bytearray:
        """The bytes held from ``at`` on, n of them unless the file ends first."""
        if len(self.held) < n:
            self.file.seek(self.at + len(self.held))
            self.held += self.file.read(max(n - len(self.held), STEP_BYTES))  # amortized: a bytearray grows in place
        return self.held


def _member(source: _Bytes, start: int) -> Record | None:
    """The record whose gzip member starts at ``start``, or None if there is none."""
    source.drop_to(start)
    unpack, out, fed, searched = zlib.decompressobj(31), bytearray(), 0, 0
    headers = None
    while not unpack.eof:
        held = source.at_least(fed + STEP_BYTES)
        if fed >= len(held):
            return None
        piece = bytes(held[fed : fed + STEP_BYTES])
        try:
            out += unpack.decompress(piece)
        except zlib.error:
            return None
        fed += len(piece) - len(unpack.unused_data)
        if headers is None:
            if not b"WARC/".startswith(bytes(out[:5])) and not out.startswith(b"WARC/"):
                return None
            stop = out.find(b"\r\n\r\n", max(searched - 3, 0))
            searched = len(out)
            if stop >= 0:
                headers = _parse_header(bytes(out[:stop]))
                if headers is None:
                    return None
    if headers is None:
        return None
    size = int(headers["content-length"])
    if len(out) < stop + 4 + size:
        return None
    return Record(headers, bytes(out[stop + 4 : stop + 4 + size]), start, start + fed)


def read_range(file, start: int, end: int) -> Iterator[Record]:
    """The records of an open file whose members start in [start, end)."""
    source, at = _Bytes(file, start), start
    while at < end:
        source.drop_to(at)
        held = source.at_least(STEP_BYTES)
        if len(held) < len(MAGIC):
            return
        found = held.find(MAGIC)
        if found < 0:
            at += len(held) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        record = _member(source, at)
        if record is None:
            at += 1
        else:
            yield record
            at = record.end


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, kind, refers_to, digest, payload) as archives; (path, size, records) of each file."""

    def run(batches):
        filesystem, base = _open_fs(folder)
        filesystem.create_dir(base, recursive=True)
        path, size, records, out = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                out = out or filesystem.open_output_stream(path, compression=None)
                name = lambda i: f"urn:page:{'' if i is None else i}"
                payload = row["payload"] or b""
                more = {"WARC-Payload-Digest": f"sha256:{row['digest']}", "X-Payload-Length": str(row["length"])}
                if row["kind"] == "revisit":
                    more |= {"WARC-Refers-To": f"<{name(row['refers_to'])}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                    payload = b""
                member = format_record(row["kind"], name(row["page_id"]), row["url"] or name(row["page_id"]), payload, more)
                out.write(member)
                size, records = size + len(member), records + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [records]}, pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return pages.select("page_id", "url", "kind", "refers_to", "digest", "length", "payload").transform(arrow_map, run, "path string, size long, records long")


def splits(files: DataFrame, most: int = SPLIT_BYTES) -> DataFrame:
    """(path, start, end): byte ranges that cover the files (path, size, ...), dealt evenly over up to MOST_TASKS tasks."""
    whole = files.where("size > 0")
    ranges = whole.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(most).cast("long"))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + most, "size").alias("end"))
    # rows are small, but each is a task's worth of work
    n = whole.agg(F.sum(F.ceil(F.col("size") / most))).first()[0] or 1
    return ranges.repartitionByRange(min(int(n), MOST_TASKS), "path", "start")


def read_archives(ranges: DataFrame, folder: str) -> DataFrame:
    """(headers, block) of every record that starts inside the ranges."""

    def run(batches):
        filesystem, _ = _open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                with filesystem.open_input_file(row["path"]) as file:
                    for record in read_range(file, row["start"], row["end"]):
                        held.append(record)
                        size += len(record.block) + sum(map(len, record.headers.values()))
                        if size > 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                if held:
                    yield _batch(held)

    return ranges.transform(arrow_map, run, "headers map<string,string>, block binary")


def _batch(records: list[Record]) -> pa.RecordBatch:
    schema = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
    return pa.RecordBatch.from_pydict({"headers": [list(r.headers.items()) for r in records], "block": [r.block for r in records]}, schema)


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, length, digest, kind and refers_to.

    Of the rows with equal payloads of at least DEDUP_FROM bytes, those of the smallest page_id are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"length": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # only digests are grouped, and only those of several pages are kept for the join
    keys = rows.where(F.col("length") >= DEDUP_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    rows = rows.join(keys.select("digest", "first"), "digest", "left")
    revisit = F.coalesce((F.col("length") >= DEDUP_FROM) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return rows.withColumns({"kind": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))})


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, from archives written and read back.

    Lengths and digests of responses are taken of the block that was read; those
    of revisits, which have no block, are the ones their records carry. A null
    html is an empty payload, a null url is replaced by the page's name. A null
    page_id stays null and never is the first of equal payloads unless all are.
    Repeated rows are written once each; equal rows of the smallest page_id are
    all responses. Other columns play no part; an empty table gives no rows.
    ValueError if not as many records are read as were written.
    """
    spark = pages.sparkSession
    folder = f"{session_dir(spark)}/{uuid.uuid4().hex}/warc"
    files = materialize(write_archives(plan_records(pages), folder), "manifest")
    records = read_archives(splits(files, split_bytes), folder)
    header = lambda name: F.col("headers").getItem(name)
    number = lambda name: F.nullif(F.regexp_extract(header(name), "urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    revisit = header("warc-type") == "revisit"
    found = records.select(
        number("warc-record-id").alias("page_id"),
        F.when(revisit, header("x-payload-length").cast("long")).otherwise(F.octet_length("block").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(header("warc-payload-digest"), ":", -1)).otherwise(F.sha2("block", 256)).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        F.when(revisit, number("warc-refers-to")).alias("refers_to"),
    )
    # without blocks and urls the result is small; it is kept so that it can be counted before it is used
    found = materialize(found, "records")
    written, read = files.agg(F.sum("records")).first()[0] or 0, found.count()
    if written != read:
        raise ValueError(f"{written} records were written, but {read} read back")
    return found
