"""WARC archives: a writer with revisit records and a salvage reader.

The reader decodes gzip members and plain records alike. After a failed check
it searches for the next member or version line that yields a valid record,
recovers from there, and logs the byte gap it leaves in quarantine.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import maybe_broadcast, slices, stored, table

ARCHIVE_BYTES = 8 << 20  # an archive is closed when it has grown beyond this
CHUNK_BYTES = 4 << 10  # first piece of a member that is inflated; pieces double up to MOST_BYTES
MOST_BYTES = 1 << 20
BROADCAST_ROWS = 200_000  # groups of equal payloads that are broadcast at most
MEMBER = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # namespace of URLs, RFC 4122


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page}')}>"


def _safe(s: str) -> str:
    """A header value: characters that would end the line are escaped."""
    return "".join(c if " " <= c and c != "\x7f" else f"%{ord(c):02X}" for c in s)


def write_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, compress: bool = True) -> bytes:
    """One record; with ``refers_to`` a revisit, which stores no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int
    end: int

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_length(self) -> int:
        """The HTTP header's length: of the full payload, in revisits too."""
        for line in self.block.partition(b"\r\n\r\n")[0].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                return int(value)
        return len(self.payload)


class Ahead:
    """First place of a pattern at or after a position that only grows: every byte is searched once."""

    def __init__(self, data: bytes, pattern: bytes):
        self.data, self.pattern, self.next = data, pattern, -1

    def of(self, at: int) -> int:
        """The length of the data where there is none."""
        if self.next < at:
            self.next = self.data.find(self.pattern, at)
            if self.next < 0:
                self.next = len(self.data)
        return self.next


def parse_record(raw: bytes, at: int, ends: Ahead | None = None) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the plain record at ``at``, if it passes all checks.

    Its header may have any length. Lines are read one by one, so that a false
    start costs no more than what lies before its first line without a colon.
    """
    if not raw.startswith(VERSION, at):
        return None
    split = (ends or Ahead(raw, b"\r\n\r\n")).of(at)
    if split >= len(raw):
        return None
    headers = {}
    line_at = raw.find(b"\r\n", at) + 2
    while line_at < split + 2:
        line_end = raw.find(b"\r\n", line_at)
        name, colon, value = raw[line_at:line_end].decode("utf-8", "replace").partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
        line_at = line_end + 2
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    start, end = split + 4, split + 4 + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        return None
    block = raw[start:end]
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
        return None
    return headers, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int] | None:
    """Bytes and end of the gzip member at ``at``.

    It is fed in pieces: the decompressor copies what follows a member within its
    last piece only, not the archive's rest.
    """
    z, out, view, step = zlib.decompressobj(31), [], memoryview(data), CHUNK_BYTES
    try:
        while not z.eof and at < len(data):
            piece = view[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece)
            step = min(2 * step, MOST_BYTES)
    except zlib.error:
        return None
    return (b"".join(out), at - len(z.unused_data)) if z.eof else None


def read_at(data: bytes, at: int, ends: Ahead | None = None) -> list[Record]:
    """The records that begin at ``at``: those of a gzip member, or a plain one; none where a check fails."""
    if data.startswith(MEMBER, at):
        if (got := inflate(data, at)) is None:
            return []
        raw, end = got
        inner, found, pos = Ahead(raw, b"\r\n\r\n"), [], 0
        while pos < len(raw):
            if (one := parse_record(raw, pos, inner)) is None:
                return []
            found.append(Record(one[0], one[1], at, end))
            pos = one[2]
        return found
    one = parse_record(data, at, ends)
    return [Record(one[0], one[1], at, one[2])] if one else []


def salvage(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """Valid records of an archive, and the gaps (start, end, reason) between them."""
    records: list[Record] = []
    gaps: list[tuple[int, int, str]] = []
    member, version, ends = Ahead(data, MEMBER), Ahead(data, VERSION), Ahead(data, b"\r\n\r\n")
    at, bad = 0, -1
    while at < len(data):
        if found := read_at(data, at, ends):
            if bad >= 0:
                gaps.append((bad, at, _reason(data, bad)))
                bad = -1
            records += found
            at = found[-1].end
            continue
        if bad < 0:
            bad = at
        at = min(member.of(at + 1), version.of(at + 1))
    if bad >= 0:
        gaps.append((bad, len(data), _reason(data, bad)))
    return records, gaps


def _reason(data: bytes, at: int) -> str:
    return "member" if data.startswith(MEMBER, at) else "record" if data.startswith(VERSION, at) else "bytes"


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages, stored in the shared folder: archive, data.

    ``pages`` needs ``page_id``, ``url`` and ``html``; other columns are
    ignored; null html is empty. Of equal payloads of at least ``least`` bytes
    the rows with the smallest page_id are responses, the others revisit it;
    rows without a page_id are responses. An archive is a run of gzip members
    that one task wrote; it is closed beyond ``archive_bytes``, so that a row is
    bounded by that and one record. No payload is shuffled while the groups that
    repeat are few enough to be broadcast.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    long_enough = F.octet_length("html") >= least
    groups = rows.filter(long_enough & F.col("page_id").isNotNull()).groupBy("key").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    groups = stored(groups.filter("first < last").select("key", "first"), "warc-groups")
    marked = rows.join(maybe_broadcast(groups, BROADCAST_ROWS), "key", "left")
    marked = marked.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        members: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{count:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["archive", "data"])

        for b in slices(batches, "html"):
            html = b.column("html").cast(pa.large_binary()).to_pylist()
            for page, url, body, first in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), html, b.column("refers_to").to_pylist(), strict=True):
                members.append(write_record(page, url, body, first))
                size += len(members[-1])
                if size > archive_bytes:
                    yield close()
                    members.clear()
                    size, count = 0, count + 1
        if members:
            yield close()

    return stored(marked.mapInArrow(run, "archive string, data binary"), "warc-archives")


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write every archive as a file of its name below ``folder``; returns archive, n_bytes.

    ``folder`` is a path or URI that Arrow's file systems open on the executors. A
    file gets its name only when it is whole, so a task that runs twice leaves one.
    Null archives are empty files; of archives with one name, one stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        where.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = batch.column("archive").to_pylist(), []
            for name, data in zip(names, batch.column("data"), strict=True):
                data = data.as_py() or b""
                part = f"{base}/_{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(data)
                where.move(part, f"{base}/{name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "n_bytes"])

    return stored(archives.select("archive", "data").mapInArrow(run, "archive string, n_bytes long"), "warc-files")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives at a path or pattern, as ``read_archives`` and ``archive_gaps`` take them.

    Any file that Spark can reach, ``.warc.gz`` or plain; a file is a row, of less
    than 2 GiB. Names that begin with ``_`` or ``.`` are skipped.
    """
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


RECORDS = "archive string, start long, end long, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Valid records of every archive; payloads of responses where asked for.

    Null and empty archives have none; a response whose payload does not match
    its digest is left out. Gaps are in ``archive_gaps``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column("archive")[i].as_py(), batch.column("data")[i].as_py()
                rows = []
                for r in salvage(data or b"")[0]:
                    h, kind = r.headers, r.headers.get("warc-type")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "response" and digest != base32_sha1(r.payload):
                        continue
                    page, first = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    rows.append((name, r.start, r.end, kind, int(page) if page else None, h.get("warc-target-uri"), digest, r.payload_length, int(first) if first else None, r.payload if payloads and kind == "response" else None))
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return archives.select("archive", "data").mapInArrow(run, RECORDS)


def archive_gaps(archives: DataFrame) -> DataFrame:
    """Byte gaps that the reader left in quarantine: archive, start, end, reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *g) for n, d in zip(batch.column("archive").to_pylist(), batch.column("data").to_pylist(), strict=True) for g in salvage(d or b"")[1]]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["archive", "start", "end", "reason"])

    return archives.select("archive", "data").mapInArrow(run, "archive string, start long, end long, reason string")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hx FROM pages),
g AS (
  SELECT page_id, body, hx, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id,
       CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((CAST('0x' || substr(hx, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
