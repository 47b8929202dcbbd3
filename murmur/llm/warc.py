"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A skippable frame then maps each record identifier to its frame and its offset
and length in that frame's content, and a last skippable frame is the seek table (compressed and decompressed size of each frame, with
a footer), as in the public seekable format. A reader finds a record from the end of the bundle and decompresses one frame only.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.base import table, written

# Fixed values of the public formats.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
#: Payloads shorter than this are never revisits.
SMALL = 100

BUNDLE_SCHEMA = "bundle_id string, n_records long, archive binary"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has no payload, but names the payload's digest, its length and the record that has it."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {json.dumps(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at the start of data."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class Bundle:
    """Collects records into frames and frames into the bytes of a bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.limit, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level).compress
        self.done, self.sizes, self.index, self.open, self.open_size, self.size = [], [], [], [], 0, 0

    def add(self, key: str, data: bytes) -> None:
        if self.open and self.open_size + len(data) > self.limit:
            self.flush()
        self.index.append((key, len(self.sizes), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)

    def flush(self) -> None:
        if self.open:
            packed = self.pack(b"".join(self.open))
            self.done.append(packed)
            self.sizes.append((len(packed), self.open_size))
            self.size += len(packed)
            self.open, self.open_size = [], 0

    def finish(self) -> bytes:
        self.flush()
        index = self.pack(json.dumps(self.index).encode())
        entries = [*self.sizes, (8 + len(index), 0)]
        table_ = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
        return b"".join([*self.done, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_SEEK, len(table_)), table_])


class Reader:
    """Random access to the records of a bundle by identifier, from its footer."""

    def __init__(self, data: bytes):
        n, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        at, self.frames = 0, []
        for packed, _ in struct.iter_unpack("<II", data[len(data) - 9 - 8 * n : len(data) - 9]):
            self.frames.append((at, packed))
            at += packed
        start, size = self.frames.pop()
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        self.index = json.loads(self.unpack(data[start + 8 : start + size]))
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, size = self.frames[k]
            self.last = (k, self.unpack(self.data[at : at + size]))
        return self.last[1]

    def records(self) -> Iterator[tuple[str, bytes]]:
        for key, k, at, size in self.index:
            yield key, self.frame(k)[at : at + size]

    def get(self, key: str) -> bytes | None:
        return next((self.frame(k)[at : at + size] for x, k, at, size in self.index if x == key), None)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = Bundle()

    def out() -> pa.RecordBatch:
        data = bundle.finish()
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([len(bundle.index)], pa.int64()), pa.array([data], pa.binary())], names=["bundle_id", "n_records", "archive"])

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
            page_id, payload = page_id.as_py(), html.as_py() or b""
            bundle.add("" if page_id is None else str(page_id), record(page_id, url.as_py(), payload, digest.as_py(), refers_to.as_py()))
            if bundle.size >= BUNDLE_BYTES:
                yield out()
                bundle = Bundle()
    if bundle.index:
        yield out()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(x: str) -> int | None:
        x = x.removeprefix("<urn:page:").removesuffix(">")
        return int(x) if x else None

    for batch in batches:
        for archive in batch.column("archive"):
            rows = []
            for _, data in Reader(archive.as_py()).records():
                headers, body = parse(data)
                refers = headers.get("WARC-Refers-To")
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                if refers is None and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                    raise ValueError(f"record {headers['WARC-Record-ID']} does not have the payload it names")
                rows.append((number(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], None if refers is None else number(refers)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def bundles(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """Rows (bundle_id, n_records, archive) with a WARC record for each row of pages (page_id, url, html).

    A null html is an empty payload and a null url is written as null. Rows with payloads of `small` bytes or more that equal one with a
    smaller page_id are revisits of the smallest; rows that repeat the smallest page_id, and rows without page_id, are responses. An empty
    table gives no bundles; further columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    brief = rows.where((F.octet_length("html") >= small) & F.col("page_id").isNotNull()).select("page_id", "digest")
    firsts = brief.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisits = brief.join(firsts, "digest").where("page_id > refers_to").distinct()
    rows = rows.join(revisits, ["page_id", "digest"], "left")
    return rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(_pack, BUNDLE_SCHEMA)


def records(archives: DataFrame) -> DataFrame:
    """The records of bundles, read back through their seek tables, with payload digests verified."""
    return archives.select("archive").mapInArrow(_unpack, RECORD_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, from bundles written to the shared folder and read back."""
    return records(written(bundles(table(spark, sf_dir, "pages")), "warc", codec="uncompressed"))


ORACLE_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= {SMALL} group by 1)
select p.page_id, payload_bytes, payload_digest,
    case when page_id > first then 'revisit' else 'response' end as record_type,
    case when page_id > first then first end as refers_to
from p left join f using (payload_digest)"""
