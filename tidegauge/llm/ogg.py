"""Media columns in Ogg: a writer, and a reader that trusts nothing.

The reader checks each page's checksum, looks for the next page where one
fails, reassembles packets from lacing values, keeps logical streams apart by
serial number, and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import blobs, slices, stored, table

RATE = 8000  # samples a second of the PCM stream
UNIT = 192  # payloads are padded to a positive multiple of this
PACKET = 4800  # samples in a packet
PAGE_SEGMENTS = 48  # lacing values in a page; 255 at most
PCM, INDEX = 0x50434D38, 0x494E4458  # serial numbers of the two logical streams
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (not reflected, zero start) through zlib's reflected one."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


class Stream:
    """Writer of one logical stream: packets in, pages out."""

    def __init__(self, serial: int):
        self.serial, self.page, self.carry = serial, 0, False
        self.lacing: list[int] = []
        self.body: list[bytes] = []
        self.granule = -1

    def packet(self, data: bytes, granule: int, out: list[bytes]) -> None:
        at, n = 0, len(data)
        for lace in (*[255] * (n // 255), n % 255):
            if len(self.lacing) == PAGE_SEGMENTS:
                self.flush(out, more=at > 0)
            self.lacing.append(lace)
            self.body.append(data[at : at + lace])
            at += lace
        self.granule = granule

    def flush(self, out: list[bytes], more: bool = False, last: bool = False) -> None:
        flags = self.carry | (self.page == 0) << 1 | last << 2
        rest = bytes(self.lacing) + b"".join(self.body)
        args = (b"OggS", 0, flags, self.granule, self.serial, self.page)
        crc = checksum(_HEAD.pack(*args, 0, len(self.lacing)) + rest)
        out.append(_HEAD.pack(*args, crc, len(self.lacing)) + rest)
        self.page, self.carry, self.granule = self.page + 1, more, -1
        self.lacing, self.body = [], []


def write_ogg(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono samples as Ogg: a PCM stream and an index stream.

    The index stream's packets give, for every PCM packet, its first sample and
    the CRC-32 of its samples.
    """
    out: list[bytes] = []
    pcm, index = Stream(PCM), Stream(INDEX)
    pcm.packet(b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, 0, 0), 0, out)
    pcm.flush(out)
    index.packet(b"PKTINDEX" + struct.pack("<II", rate, PACKET), 0, out)
    index.flush(out)
    for at in range(0, len(samples), PACKET):
        part = samples[at : at + PACKET]
        index.packet(struct.pack("<QI", at, zlib.crc32(part)), at + len(part), out)
        pcm.packet(part, at + len(part), out)
        if len(index.lacing) >= 32:
            index.flush(out)
    pcm.flush(out, last=True)
    index.flush(out, last=True)
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream as read: packets and the granules of their pages."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # -1 where the page end tells nothing of it
    next_page: int = 0
    lost_pages: int = 0
    ended: bool = False
    open: list[bytes] | None = None

    def seconds(self, rate: int) -> float:
        return max([g for g in self.granules if g >= 0], default=0) / rate


@dataclass
class Container:
    streams: dict[int, Logical] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0
    skipped: list[tuple[int, int]] = field(default_factory=list)


def _page(data: bytes, at: int) -> int:
    """Length of the valid page at ``at``, or 0."""
    if len(data) - at < _HEAD.size or data[at : at + 4] != b"OggS" or data[at + 4]:
        return 0
    n = data[at + 26]
    end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
    if at + 27 + n > len(data) or end > len(data):
        return 0
    raw = data[at:end]
    crc = int.from_bytes(raw[22:26], "little")
    return end - at if checksum(raw[:22] + b"\0\0\0\0" + raw[26:]) == crc else 0


def read_ogg(data: bytes) -> Container:
    """Logical streams of a physical one; bad bytes are skipped and noted."""
    box, at, n = Container(), 0, len(data)
    while at < n:
        size = _page(data, at)
        if not size:
            box.bad_pages += data[at : at + 4] == b"OggS"
            to = data.find(b"OggS", at + 1)
            to = n if to < 0 else to
            if box.skipped and box.skipped[-1][1] == at:
                box.skipped[-1] = (box.skipped[-1][0], to)
            else:
                box.skipped.append((at, to))
            at = to
            continue
        _, _, flags, granule, serial, number, _, count = _HEAD.unpack_from(data, at)
        s = box.streams.setdefault(serial, Logical())
        if number != s.next_page:
            s.lost_pages += max(0, number - s.next_page)
            s.open = None  # a packet that was being read lost its middle
        elif not flags & 1:
            s.open = None
        s.next_page = number + 1
        s.ended |= bool(flags & 4)
        # a continued packet whose start was lost is dropped up to its end
        body, lost = at + 27 + count, bool(flags & 1) and s.open is None
        part, first = s.open or [], len(s.packets)
        for lace in data[at + 27 : at + 27 + count]:
            part.append(data[body : body + lace])
            body += lace
            if lace < 255:
                if not lost:
                    s.packets.append(b"".join(part))
                    s.granules.append(-1)
                part, lost = [], False
        s.open = part if part and not lost else None
        if len(s.packets) > first:
            s.granules[-1] = granule
        box.pages += 1
        at += size
    return box


def features(box: Container) -> str:
    """What the samples and the container show, as a short text."""
    pcm = box.streams.get(PCM, Logical())
    rate = struct.unpack_from(">I", pcm.packets[0], 16)[0] if pcm.packets else RATE
    x = np.frombuffer(b"".join(pcm.packets[1:]), np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    peak = int(np.abs(x).max()) if len(x) else 0
    return (
        f"streams={len(box.streams)};pages={box.pages};bad={box.bad_pages};packets={sum(len(s.packets) for s in box.streams.values())};"
        f"seconds={pcm.seconds(rate):.6f};mean={x.sum() / n:.6f};rms={np.sqrt((x * x).sum() / n):.6f};peak={peak};crossings={crossings}"
    )


def payload(raw: bytes) -> bytes:
    """A text's bytes, padded with spaces to a positive multiple of UNIT."""
    return raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT))


def store_media(docs: DataFrame) -> DataFrame:
    """Every whole text as an Ogg column.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null text
    is empty, and the empty text is one unit of padding. Equal texts give equal
    media. Returns doc_id, n_bytes (before padding), media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            raw = blobs(b.column("text"))
            media = pa.array([write_ogg(payload(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), media], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_packets(media: DataFrame) -> DataFrame:
    """Packets of every logical stream: doc_id, serial, packet, seconds, data.

    ``media`` needs ``doc_id`` and ``media``. ``seconds`` is the time at which a
    packet ends, null where no granule position tells it. Null media has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "serial", "packet", "seconds", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        for b in slices(batches, "media"):
            rows = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                for serial, s in read_ogg(raw or b"").streams.items():
                    rows += [(doc, serial, i, g / RATE if g >= 0 else None, p) for i, (p, g) in enumerate(zip(s.packets, s.granules, strict=True))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, serial long, packet long, seconds double, data binary")


def read_media(media: DataFrame) -> DataFrame:
    """Read stored media back: payload and media digests, and features.

    ``media`` needs ``doc_id``, ``n_bytes`` and ``media``. Null or damaged media
    gives what could be read, which may be the empty payload; ``bad_pages`` counts
    pages that failed their checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bad_pages"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in slices(batches, "media"):
            rows = []
            for raw in b.column("media").to_pylist():
                box = read_ogg(raw or b"")
                data = b"".join(box.streams[PCM].packets[1:]) if PCM in box.streams else b""
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), features(box), box.bad_pages))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op2_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(store_media(table(spark, sf_dir, "documents")), "ogg-media")
    return read_media(media)
