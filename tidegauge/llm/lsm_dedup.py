"""Exact dedup by a log-structured merge index over digests of normalised texts.

Each task is a writer: rows enter a memtable keyed by the SHA-256 of the text
without white space; a full memtable is flushed as a run sorted by digest, with
a Bloom filter over its digests; a few runs are compacted into one, where the
filters tell which digests need a look at other runs. Runs carry, per digest,
the best row, the number of rows, their ids and one zstd copy of the text.
Compacted runs of all tasks are merged by one shuffle on the digest; the merge
streams through sorted entries. Every hit, in a memtable, in compaction and in
the merge, is verified by the bytes of the texts (so equal digests of different
texts stay apart); the best identifier is kept.

A digest that a third of all rows share has one entry per run, not per row,
so no task meets it as a hot key, and the ids stay in their run's entry until
the final explode.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE_BYTES, one_of_each, slices, stored, table, text_hash

RUN_SCHEMA = "digest binary, chars long, id long, n long, ids array<long>, hashes array<long>, body binary"
FAN_IN = 4  # runs that a writer compacts into one
MERGED_SCHEMA = "digest binary, variant int, chars long, id long, n long, ids array<long>, hashes array<long>"
BROADCAST_ROWS = 1_000_000  # marks of rows that are broadcast at most; beyond, tables are joined


class Bloom:
    """Filter over digests: one bit for each of 7 slices of the digest."""

    def __init__(self, entries: int):
        self.bits = max(64, 1 << (max(1, entries) * 10 - 1).bit_length())
        self.map = np.zeros(self.bits // 8, np.uint8)

    def _at(self, digests: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(d.ljust(32, b"\0")[:28] for d in digests), "<u4").reshape(len(digests), 7)
        return raw.astype(np.int64) % self.bits

    def add(self, digests: list[bytes]) -> None:
        at = self._at(digests).ravel()
        np.bitwise_or.at(self.map, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def may_hold(self, digests: list[bytes]) -> np.ndarray:
        at = self._at(digests)
        return ((self.map[at >> 3] >> (at & 7)) & 1).all(axis=1)


@dataclass
class Entry:
    """One text of a run: its best row, its rows' ids and text hashes, and a zstd copy."""

    body: bytes
    chars: int
    id: int | None
    ids: list
    hashes: list

    def rank(self) -> tuple:
        return -self.chars, self.id is None, self.id or 0

    def absorb(self, other: Entry) -> None:
        """Keep the better identifier and all ids of an equal text."""
        if other.rank() < self.rank():
            self.chars, self.id = other.chars, other.id
        self.ids += other.ids
        self.hashes += other.hashes


class Run:
    """Entries in digest order, found by binary search behind a filter."""

    def __init__(self, keys: list[bytes], entries: list[list[Entry]]):
        self.keys, self.entries = keys, entries
        self.filter = Bloom(len(keys))
        if keys:
            self.filter.add(keys)

    def get(self, digest: bytes) -> list[Entry]:
        at = bisect_left(self.keys, digest)
        return self.entries[at] if at < len(self.keys) and self.keys[at] == digest else []


class Writer:
    """A memtable of bounded bytes, and the runs that were flushed from it.

    After FAN_IN flushes the runs are compacted into one: digests that no other
    run's filter may hold pass straight on, the others are looked up, and hits
    are merged only where the bytes of the texts agree. The compacted run is
    emitted, so a writer holds no more than FAN_IN runs.
    """

    def __init__(self, memtable_bytes: int):
        self.limit, self.size = memtable_bytes, 0
        self.table: dict[bytes, list[Entry]] = {}
        self.runs: list[Run] = []
        self.pack = zstandard.ZstdCompressor(level=1)
        self.unpack = zstandard.ZstdDecompressor()

    def put(self, digest: bytes, body: bytes, chars: int, doc: int | None, row: int) -> None:
        new = Entry(body, chars, doc, [doc], [row])
        same = self.table.setdefault(digest, [])
        for e in same:
            if e.body == body:
                e.absorb(new)
                self.size += 80
                return
        same.append(new)
        self.size += len(body) + 300

    def full(self) -> bool:
        return self.size >= self.limit

    def flush(self) -> None:
        """The memtable becomes a run in digest order; bodies are packed."""
        keys = sorted(self.table)
        for k in keys:
            for e in self.table[k]:
                e.body = self.pack.compress(e.body)
        if keys:
            self.runs.append(Run(keys, [self.table[k] for k in keys]))
        self.table, self.size = {}, 0

    def same(self, a: Entry, b: Entry) -> bool:
        return a.body == b.body or self.unpack.decompress(a.body) == self.unpack.decompress(b.body)

    def compact(self) -> pa.RecordBatch | None:
        """All runs as one, in digest order."""
        if not self.runs:
            return None
        out: list[tuple[bytes, list[Entry]]] = []
        for i, run in enumerate(self.runs):
            earlier = np.zeros(len(run.keys), bool)
            later = np.zeros(len(run.keys), bool)
            for j, other in enumerate(self.runs):
                if j != i:
                    (earlier if j < i else later)[other.filter.may_hold(run.keys)] = True
            for at, (k, entries) in enumerate(zip(run.keys, run.entries, strict=True)):
                if earlier[at] and any(r.get(k) for r in self.runs[:i]):
                    continue  # an earlier run took it along
                if later[at]:
                    for r in self.runs[i + 1 :]:
                        for e in r.get(k):
                            hit = next((x for x in entries if self.same(x, e)), None)
                            if hit is None:
                                entries.append(e)
                            else:
                                hit.absorb(e)
                out.append((k, entries))
        self.runs = []
        out.sort(key=lambda x: x[0])
        rows = [(k, e.chars, e.id, len(e.ids), e.ids, e.hashes, e.body) for k, entries in out for e in entries]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["digest", "chars", "id", "n", "ids", "hashes", "body"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def index_runs(docs: DataFrame, digest_bytes: int, memtable_bytes: int) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(memtable_bytes)
        for b in slices(batches, "text"):
            col = b.column("text").fill_null("")
            chars = pc.utf8_length(col).to_pylist()
            for doc, body, n, row in zip(b.column("doc_id").to_pylist(), col.cast(pa.large_binary()).to_pylist(), chars, b.column("hash").to_pylist(), strict=True):
                body = body.translate(None, SPACE_BYTES)
                out.put(hashlib.sha256(body).digest()[:digest_bytes], body, n, doc, row)
                if out.full():
                    out.flush()
                    if len(out.runs) == FAN_IN:
                        yield out.compact()
        out.flush()
        if (last := out.compact()) is not None:
            yield last

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("hash", text_hash()).mapInArrow(write, RUN_SCHEMA)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Verify hits across runs: every entry gets the number of its text under its digest.

    Entries arrive sorted by digest, so the merge holds only the texts of the
    digest at hand: one, unless digests collide.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        last, bodies, packed = None, [], []
        for b in batches:
            variants = []
            for d, z in zip(b.column("digest").to_pylist(), b.column("body").to_pylist(), strict=True):
                if d != last:
                    last, bodies, packed = d, [], []
                if z in packed:  # same writer settings give the same bytes for the same text
                    variants.append(packed.index(z))
                    continue
                if packed:
                    if not bodies:
                        bodies = [unpack.decompress(x) for x in packed]
                    body = unpack.decompress(z)
                    if body in bodies:
                        variants.append(bodies.index(body))
                        continue
                    bodies.append(body)
                packed.append(z)
                variants.append(len(packed) - 1)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(variants, pa.int32()), *(b.column(c) for c in ("chars", "id", "n", "ids", "hashes"))], names=["digest", "variant", "chars", "id", "n", "ids", "hashes"])

    sorted_runs = runs.repartition("digest").sortWithinPartitions("digest")
    return sorted_runs.mapInArrow(merge, MERGED_SCHEMA)


def equal_groups(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 12 << 20) -> DataFrame:
    """``exact_dedup`` with what tells rows apart: text_hash, and the group as grp."""
    entries = stored(merge_runs(index_runs(docs, digest_bytes, memtable_bytes)), "lsm-merged")
    best = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("i"))
    compacted = entries.groupBy("digest", "variant").agg(F.min(best).alias("best"), F.sum("n").alias("group_size"))
    rows = entries.select("digest", "variant", F.arrays_zip("ids", "hashes").alias("rows")).join(compacted, ["digest", "variant"])
    rows = rows.select(F.explode("rows").alias("r"), F.col("best.i").alias("keep_id"), "group_size", "digest", F.struct("digest", "variant").alias("grp"))
    return rows.select(F.col("r.ids").alias("doc_id"), "keep_id", "group_size", "digest", F.col("r.ids").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("r.hashes").alias("text_hash"), "grp")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, memtable_bytes: int = 12 << 20) -> DataFrame:
    """Groups of equal texts, and which row of each stays.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, whatever
    their names. Null text counts as empty; texts are equal when identical
    without ASCII white space; the empty text is a group like any other. The row
    with the most code points stays, then the smallest doc_id; rows with a null
    doc_id come last in ties. Rows that repeat the kept doc_id in its group are all
    kept. Repeated rows count each time. A text may have any length: a memtable is
    flushed behind the row that fills it. An empty table gives an empty result.
    Returns one row per document: doc_id, keep_id, group_size, kept, digest.
    """
    return equal_groups(docs, digest_bytes, memtable_bytes).select("doc_id", "keep_id", "group_size", "digest", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the longest, then that
    with the smallest doc_id.

    All columns stay. Groups without any doc_id keep one row too; of rows that
    repeat, one stays.
    """
    return one_of_each(docs, equal_groups(docs), BROADCAST_ROWS)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY chars DESC, doc_id)
"""
