"""Packing by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into full windows and smaller pieces; the pieces
of a block are split into near-equal windows by the largest differencing method
on k-way partial partitions. Where the fullest window exceeds the capacity the
window count rises and the block is solved again.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import slices, table, texts

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
BLOCK = 4096  # pieces solved together; bounds memory and time of one solve
_CODECS: dict[str, ByteBPE] = {}


class ByteBPE:
    """Ids of a byte-level BPE file, equal to those of the tokenizers library.

    Ordinary text goes through tiktoken with the file's own vocabulary as
    ranks; texts that hold a special token's string, or characters on whose
    class the two libraries' Unicode tables may differ, go through tokenizers.
    """

    RARE = re.compile("[^\\x00-\u052f\u2000-\u206f\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        if (not text.isascii() and self.RARE.search(text)) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def codec(path: str) -> ByteBPE:
    if path not in _CODECS:
        _CODECS[path] = ByteBPE(path)
    return _CODECS[path]


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item, by differencing of k-way partial partitions.

    A partial partition is k loads; the two with the largest spread are merged,
    largest loads of one onto smallest of the other. Only non-zero loads are
    kept, in ascending order; each names a node of the tree of items below it.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = n
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        if len(a) < len(b):
            a, an, b, bn = b, bn, a, an
        free = k - len(a)
        # the |b| smallest slots of a, zeros first, meet b's loads from the largest down
        meet = max(0, len(b) - free)
        loads, nodes = a.copy(), an.copy()
        for j in range(meet):
            # b ascending: its largest take the free slots, its smallest the loaded ones
            loads[j] += b[meet - 1 - j]
            left.append(int(nodes[j]))
            right.append(int(bn[meet - 1 - j]))
            nodes[j] = len(left) - 1
        loads, nodes = np.concatenate([loads, b[meet:]]), np.concatenate([nodes, bn[meet:]])
        order = np.argsort(loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        spread = int(loads[-1]) - (int(loads[0]) if len(loads) == k else 0)
        heapq.heappush(heap, (-spread, count, loads, nodes))
        count += 1
    out = np.zeros(n, np.int64)
    for w, top in enumerate(heap[0][3] if heap else []):
        stack = [int(top)]
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = w
            else:
                stack += [left[x], right[x]]
    return out


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item such that no window exceeds the capacity."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        out = difference(sizes, k)
        top = int(np.bincount(out, sizes, k).max())
        if top <= capacity or k >= len(sizes):
            return out if top <= capacity else np.arange(len(sizes))
        k += max(1, k // 256)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, block: int = BLOCK) -> DataFrame:
    """Pieces of documents and the sequences that hold them.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts have the end id alone. Full windows stand alone; what remains is
    cut at half a window, so that pieces pair up, and ``block`` such pieces of a
    task are packed together: nothing is shuffled, and no task holds more than a
    block. Sequence numbers carry the task's
    number in their upper bits. ``padded_length`` is the sequence's stored
    length: its own where that is a power of two, else the capacity. Repeated
    rows are packed each. An empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut = max(1, capacity // 2)
        enc, base = codec(tokenizer), TaskContext.get().partitionId() << 40
        pending: list[tuple] = []
        rows: list[tuple] = []
        made = 0

        def settle() -> None:
            nonlocal made
            sizes = np.array([p[2] for p in pending], np.int64)
            at = windows(sizes, capacity)
            filled: dict[int, int] = {}
            total = np.bincount(at, sizes).astype(int) if len(at) else []
            for w, p in zip(at.tolist(), pending, strict=True):
                off = filled.get(w, 0)
                filled[w] = off + p[2]
                t = int(total[w])
                rows.append((*p, base + made + w, off, t if t & (t - 1) == 0 else capacity))
            made += int(at.max()) + 1 if len(at) else 0
            pending.clear()

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")])

        for b in slices(batches, "text"):
            for doc, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                ids = np.append(enc.encode(text), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                raw = memoryview(ids.tobytes())
                for s in range(0, n - capacity + 1, capacity):
                    rows.append((doc, s, capacity, zlib.crc32(raw[4 * s : 4 * (s + capacity)]), n, base + made, 0, capacity))
                    made += 1
                for s in range(n - n % capacity, n, cut):
                    e = min(n, s + cut)
                    pending.append((doc, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n))
                if len(pending) >= block:
                    settle()
            if len(rows) >= 4096:
                yield out()
        settle()
        yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
