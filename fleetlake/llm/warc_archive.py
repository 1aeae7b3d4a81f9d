"""Pages as WARC archives, and a sequential reader for them.

Each record is a gzip member of its own. Pages with equal payloads are written once as a response; the others are
revisit records that name it. The reader inflates incrementally, frames records by their content length and checks
block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a file is closed.
FILE_BYTES = 16 << 20
PIECE = 64 << 10
DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in lines), b"\r\n"])
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _name(key: object) -> str:
    return f"<urn:x-page:{quote('' if key is None else str(key), safe='')}>"


def page_record(key: object, url: str | None, payload: bytes, payload_digest: str, refers_to: object = None, revisit: bool = False) -> bytes:
    """A response with the payload, or a revisit with the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _name(key)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=-._~"))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{payload_digest}")]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    return record(fields, head if revisit else head + payload)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload_digest(self) -> str:
        return self.headers["warc-payload-digest"].removeprefix("sha1:")

    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        fields = (line.partition(":") for line in head.decode().split("\r\n")[1:])
        return {k.strip().lower(): v.strip() for k, _, v in fields}, body


def key_of(name: str) -> str | None:
    """The page's key as text (None: it was null)."""
    return unquote(name.removeprefix("<urn:x-page:").removesuffix(">")) or None


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of each gzip member, inflated piece by piece."""
    rest, z, out = b"", None, bytearray()
    for piece in pieces:
        rest += piece
        while rest:
            z = z or zlib.decompressobj(31)
            out += z.decompress(rest)
            rest = z.unused_data if z.eof else b""
            if z.eof:
                yield bytes(out)
                z, out = None, bytearray()
    if z is not None:
        raise ValueError("the archive ends within a record")


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Records of an archive that comes in pieces. Raises ValueError on broken framing or digests."""
    for plain in _inflated(pieces):
        head, found, rest = plain.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not found or lines[0] not in (b"WARC/1.0", VERSION):
            raise ValueError("not a WARC record")
        fields = (line.decode().partition(":") for line in lines[1:])
        headers = {k.strip().lower(): v.strip() for k, _, v in fields}
        length = int(headers["content-length"])
        if rest[length:] != b"\r\n\r\n":
            raise ValueError("the record isn't as long as its content length says")
        one = Record(headers, rest[:length])
        if headers.get("warc-block-digest", f"sha1:{digest(one.block)}") != f"sha1:{digest(one.block)}":
            raise ValueError("block digest differs")
        if headers.get("warc-type") == "response" and "warc-payload-digest" in headers and digest(one.http()[1]) != one.payload_digest:
            raise ValueError("payload digest differs")
        yield one


def planned(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """key, url, payload, revisit and refers_to of every page: of the pages with equal payloads of at least ``least``
    bytes that with the smallest key stays, the others refer to it. Null payloads are empty.

    Groups are found on digests; a payload that a large part of all pages share is one row per task before the
    shuffle, and payloads themselves move only to meet their page's decision, by key.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    groups = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("key").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 AND refers_to IS NOT NULL").drop("n")
    later = rows.select("key", "digest").join(groups, "digest").where(~F.col("key").eqNullSafe(F.col("refers_to"))).distinct()
    later = later.withColumnsRenamed({"key": "__key", "digest": "__digest"})
    met = rows.join(later, F.col("key").eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__digest")), "left")
    return met.select("key", "url", "payload", F.col("__digest").isNotNull().alias("revisit"), "refers_to")


def write(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes a record per page to archives in ``folder`` (default: a new one in the shared folder) and returns the
    list of files: path, n_records, n_bytes. Tasks take their rows in key order, nulls first, and each attempt of a
    task writes files of its own: the list, which names those of the attempts that counted, says what the archives
    are. An empty table gives none; rows that repeat with key and payload are each a response."""
    spark = pages.sparkSession
    folder = folder or shared.fresh_path(spark, "warc")
    plan = planned(pages, **columns).sortWithinPartitions(F.col("key").asc_nulls_first(), "url", "payload")
    shared.bounded_batches(spark)
    shared.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, piece, part, attempt = [], 0, 0, TaskContext.get().partitionId(), uuid.uuid4().hex[:12]

        def flush() -> pa.RecordBatch:
            data = b"".join(out)
            path = f"{folder}/part-{part:06d}-{piece:04d}-{attempt}.warc.gz"
            shared.put_file(path, data)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([len(data)])], names=["path", "n_records", "n_bytes"])

        held = 0
        for batch in batches:
            for k, u, p, again, to in zip(*(batch.column(c) for c in ("key", "url", "payload", "revisit", "refers_to"))):
                body = p.as_py()
                out.append(page_record(k.as_py(), u.as_py(), body, digest(body), to.as_py(), again.as_py()))
                n, held = n + 1, held + len(out[-1])
                if held >= FILE_BYTES:
                    yield flush()
                    out, n, held, piece = [], 0, 0, piece + 1
        if out:
            yield flush()

    listed = shared.arrow_map(plan, run, "path string, n_records long, n_bytes long").collect()  # a row per file
    # as a written table its size is known, so that the join in read() sends it to all while it is small
    return shared.written(spark, spark.createDataFrame([tuple(x) for x in listed], "path string, n_records long, n_bytes long").coalesce(1), "warc-files")


def read(spark: SparkSession, files: DataFrame, bodies: bool = True) -> DataFrame:
    """A row per record of the listed archives, whatever else lies in their folders: key (as text), url, payload_bytes and payload_digest (base32 SHA-1)
    of the full payload, record_type, refers_to (as text; null for responses) and, if ``bodies``, the payload (null
    for revisits)."""
    shared.bounded_batches(spark)
    shared.ship(spark)
    schema = "key string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", payload binary" if bodies else "")
    content = shared.listed_content(spark, files.select("path"), "*.warc.gz")
    if content is None:
        return spark.createDataFrame([], schema)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()][: len(names)]

    def rows(data: memoryview) -> Iterator[tuple]:
        for r in records(bytes(data[k : k + PIECE]) for k in range(0, len(data), PIECE)):
            http, body = r.http()
            revisit = r.headers["warc-type"] == "revisit"
            refers = key_of(r.headers["warc-refers-to"]) if revisit else None
            yield key_of(r.headers["warc-record-id"]), unquote(r.headers["warc-target-uri"]), int(http["content-length"]), r.payload_digest, r.headers["warc-type"], refers, None if revisit else body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                group, held = [], 0
                for row in rows(memoryview(content.as_buffer())):
                    group.append(row[: len(names)])
                    held += len(row[-1] or b"") if bodies else 0
                    if len(group) >= shared.BATCH_ROWS or held >= shared.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*group), kinds)], names)
                        group, held = [], 0
                if group:
                    yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*group), kinds)], names)

    return shared.arrow_map(content.select("content"), run, schema)
