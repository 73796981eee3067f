"""MinHash near-dedup by a multi-index Hamming join.

Every distinct shingle set gets a signature of SYMBOLS b-bit MinHash values. Two
sets of similarity 0.75 differ in a quarter of them on average; all pairs that
differ in at most ``THRESHOLD`` are found: by pigeonhole one of the CHUNKS chunks
then has at most one wrong symbol, and the index holds each chunk once for each
symbol that may be wrong. (At similarity 0.75 a pair passes the threshold with
probability 0.99997, above that more surely.)

Sets, not documents, are joined; copies stay in their task's row until the end.
Within a bucket no pairs are emitted: members are first linked to the smallest
member they share most buckets with, verified on full sets, and grouped. Buckets
that still hold several groups are searched through in cells of bounded size: a
cell holds some nodes and those that meet them in a bucket, first with signatures
only, then with the texts of those nodes that have a partner of another group
within the distance. Links come out, never pairs.

Full sets are compared as 64-bit hashes of word shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lower_ascii, maybe_broadcast, mix64, one_of_each, settled, shingle_hashes, slices, span_hashes, stored, table, text_bytes, text_hash, word_spans
from .components import components

K = 5  # words in a shingle
SYMBOLS, CHUNKS = 64, 16
WIDTH = SYMBOLS // CHUNKS
THRESHOLD = 2 * CHUNKS - 1  # beyond it every chunk may have two errors
NUMERATOR, DENOMINATOR = 75, 100
FLUSH_SETS, FLUSH_IDS = 20_000, 1_000_000  # what a task gathers before it emits
CELL_SETS, CELL_SHINGLES = 256, 500_000  # sets of a cell on either side, and shingles of those that it holds
BROADCAST_ROWS = 500_000
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "cls binary, n long, sig binary, first long, hash long, rows array<struct<doc_id:long,text_hash:long>>"


def shingle_sets(col: pa.Array, k: int = K) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words, of all of them."""
    data, offs = text_bytes(col)
    low = lower_ascii(data)
    starts, ends, row = word_spans(low, offs)
    words = span_hashes(low, starts, ends)
    cut = np.searchsorted(row, np.arange(len(col) + 1))
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            n = b - a
            out.append(np.unique(shingle_hashes(words[a:b], min(n, k)) + np.uint64(n if n < k else k)) if n else np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """Low 16 bits of the minimum under each multiplication."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1024):
            np.minimum(low, (shingles[at : at + 1024, None] * _FACTORS).min(axis=0), out=low)
    return mix64(low).astype(np.uint16).tobytes()


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("hash", text_hash())


def sketch(docs: DataFrame) -> DataFrame:
    """Distinct sets of each task's rows, with the rows that have them, and one
    row whose text stands for the set: that with the smallest doc_id.
    """
    row = pa.struct([("doc_id", pa.int64()), ("text_hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes | None, list] = {}
        count = 0

        def out() -> pa.RecordBatch:
            best = [min(zip(ids, hashes, strict=True), key=lambda x: (x[0] is None, x[0] or 0, x[1])) for _, _, ids, hashes in held.values()]
            size = pa.array(np.r_[0, np.cumsum([len(e[2]) for e in held.values()])].astype(np.int32))
            flat = [pa.array([x for e in held.values() for x in e[i]], pa.int64()) for i in (2, 3)]
            cols = [
                pa.array(list(held), pa.binary()),
                pa.array([e[0] for e in held.values()], pa.int64()),
                pa.array([e[1] for e in held.values()], pa.binary()),
                *(pa.array([b[i] for b in best], pa.int64()) for i in (0, 1)),
                pa.ListArray.from_arrays(size, pa.StructArray.from_arrays(flat, fields=list(row))),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["cls", "n", "sig", "first", "hash", "rows"])

        for b in slices(batches, "text"):
            for doc, h, s in zip(b.column("doc_id").to_pylist(), b.column("hash").to_pylist(), shingle_sets(b.column("text")), strict=True):
                key = set_key(s) if len(s) else None
                if (entry := held.get(key)) is None:
                    entry = held[key] = [len(s), signature(s) if len(s) else None, [], []]
                entry[2].append(doc)
                entry[3].append(h)
                count += 1
            if len(held) >= FLUSH_SETS or count >= FLUSH_IDS:
                yield out()
                count = 0
        yield out()

    return _rows(docs).mapInArrow(run, SKETCH)


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """Index keys of signatures (rows of uint16): chunk by chunk, one symbol left out."""
    s = sigs.reshape(len(sigs), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(sigs), CHUNKS, WIDTH), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WIDTH):
            key = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(j + 1)
            for i in range(WIDTH):
                if i != j:
                    key = mix64(key * np.uint64(65537) + s[:, :, i])
            out[:, :, j] = key
    return out.reshape(len(sigs), -1).view(np.int64)


def _signatures(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))


def index(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets with two or more nodes, as two tables (key, node, head).

    The first has, for each task's block of rows, the nodes that meet a smaller
    one of their block (the head) in a bucket. The second has the smallest node
    of each block in each bucket; its head is the smallest of all. Only these are
    shuffled by key, so a bucket has one row for each block, however many members,
    and buckets of one node end here.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column("node").to_numpy()
            order = np.argsort(node, kind="stable")
            node, keys = node[order], chunk_keys(_signatures(b.column("sig")))[order]
            flat, who = keys.ravel(), np.repeat(node, keys.shape[1])
            by = np.lexsort((who, flat))
            flat, who = flat[by], who[by]
            head = np.r_[True, flat[1:] != flat[:-1]]
            at = np.flatnonzero(head)
            first = who[at[np.cumsum(head) - 1]]
            alone = np.diff(np.r_[at, len(flat)]) == 1
            yield _batch(key=flat[~head], node=who[~head], head=first[~head])
            # block heads: -1 alone, -2 with others of the block
            yield _batch(key=flat[head], node=who[head], head=np.where(alone, -1, -2))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3  # the last bucket's rows, unless a row of it is out already
        open_key, open_head = None, 0

        def of(key: np.ndarray, node: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
            fresh = np.r_[True, key[1:] != key[:-1]][: len(key)]
            at = np.flatnonzero(fresh)
            which = np.cumsum(fresh) - 1
            size = np.diff(np.r_[at, len(key)])
            many = (size[which] > 1) | (mark[at] == -2)[which] if len(key) else fresh
            first = node[at][which] if len(key) else node
            if len(key) and key[0] == open_key:
                first = np.where(which == 0, open_head, first)
                many = many | (which == 0)
            return _batch(key=key[many], node=node[many], head=first[many])

        for b in batches:
            if not b.num_rows:
                continue
            key, node, mark = (np.concatenate([r, b.column(c).to_numpy()]) for r, c in zip(rest, ("key", "node", "head"), strict=True))
            cut = int(np.searchsorted(key, key[-1], "left")) if np.all(key[1:] >= key[:-1]) else int(np.flatnonzero(key != key[-1])[-1]) + 1
            if cut == 0 and len(key) > 1 << 16:  # a hot bucket: its rows go out, the head stays
                yield of(key, node, mark)
                if key[0] != open_key:
                    open_key, open_head = key[0], node[0]
                rest = [x[:0] for x in (key, node, mark)]
                continue
            if cut:
                yield of(key[:cut], node[:cut], mark[:cut])
            rest = [key[cut:], node[cut:], mark[cut:]]
        if len(rest[0]):
            yield of(*rest)

    # blocks: rows of a task in Arrow batches, so memory stays bounded
    made = stored(nodes.select("node", "sig").mapInArrow(local, "key long, node long, head long"), "mih-local")
    heads = made.filter("head < 0").repartition("key").sortWithinPartitions("key", "node")
    return made.filter("head >= 0"), stored(heads.mapInArrow(across, "key long, node long, head long"), "mih-heads")


CELL = "cx long, cy long, role int, node long"


def first_cells(inner: DataFrame, heads: DataFrame) -> DataFrame:
    """For each node the smaller node that it shares most buckets with, in cells
    of one such head (role 0) and up to CELL_SETS nodes (role 1).
    """
    pairs = inner.select("node", "head").union(heads.filter("node <> head").select("node", "head")).groupBy("node", "head").agg(F.count("*").alias("hits"))
    best = pairs.groupBy("node").agg(F.max(F.struct("hits", (-F.col("head")).alias("h"))).alias("b"))
    best = stored(best.select("node", (-F.col("b.h")).alias("head")), "mih-first")
    shares = best.groupBy("head").agg(F.ceil(F.count("*") / CELL_SETS).cast("long").alias("shares"))
    held = shares.select(F.col("head").alias("cx"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("cy"), F.lit(0).alias("role"), F.col("head").alias("node"))
    share = F.pmod(F.xxhash64("node"), F.col("shares"))
    return held.union(best.join(shares, "head").select(F.col("head").alias("cx"), share.alias("cy"), F.lit(1).alias("role"), "node"))


def open_cells(nodes: DataFrame, inner: DataFrame, heads: DataFrame, groups: DataFrame) -> DataFrame:
    """Cells of nodes that meet in a bucket of several groups.

    ``groups`` (node, root) names the group of a node; others are on their own. The
    smallest group of a node's largest such bucket is its home, so that nodes which
    meet have few homes. A node is sent to each home that it meets and that is no
    smaller than its own (role 1), past the nodes at home there (role 0), in cells
    of up to about CELL_SETS of either.
    """
    members = inner.select("key", "node").union(heads.select("key", "node"))
    known = members.join(maybe_broadcast(groups, BROADCAST_ROWS), "node", "left").withColumn("grp", F.coalesce("root", "node"))
    opened = known.groupBy("key").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("c")).filter("low < high").select("key", "c", "low")
    met = stored(known.join(maybe_broadcast(stored(opened, "mih-open"), BROADCAST_ROWS), "key").select("key", "c", "low", "node"), "mih-met")
    home = met.groupBy("node").agg(F.max(F.struct("c", (-F.col("low")).alias("low"))).alias("h")).select("node", (-F.col("h.low")).alias("home")).join(nodes.select("node", "n"), "node")
    home = stored(home, "mih-home")
    sizes = home.groupBy("home").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.count("*") / CELL_SETS, F.sum("n") / CELL_SHINGLES)).cast("long").alias("parts"))
    placed = stored(met.select("key", "node").join(home.select("node", "home").join(sizes, "home"), "node"), "mih-placed")
    others = placed.select("key", F.struct("size", "home").alias("other"), "parts").distinct()
    hits = placed.drop("parts").join(others, "key").filter(F.col("other") >= F.struct("size", "home")).select("node", F.col("other.home").alias("home"), "parts").distinct()
    hits = stored(hits, "mih-hits")
    shares = hits.groupBy("home", "parts").agg(F.ceil(F.count("*") / CELL_SETS).cast("long").alias("shares"))
    spot = F.xxhash64("node")
    every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    held = home.select("node", "home").join(shares, "home").select("node", "home", "shares", F.pmod(spot, F.col("parts")).alias("part"), F.explode(every("shares")).alias("share"), F.lit(0).alias("role"))
    sent = hits.join(shares.drop("parts"), "home").select("node", "home", "shares", F.explode(every("parts")).alias("part"), F.pmod(spot, F.col("shares")).alias("share"), F.lit(1).alias("role"))
    return held.union(sent).select(F.col("home").alias("cx"), (F.col("part") * F.col("shares") + F.col("share")).alias("cy"), "role", "node")


def near_cells(cells: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of cells that have a partner of another group within the distance."""
    named = nodes.select("node", "n", "sig").join(maybe_broadcast(groups, BROADCAST_ROWS), "node", "left").withColumn("grp", F.coalesce("root", "node"))
    rows = cells.join(named.select("node", "n", "sig", "grp"), "node").repartition("cx", "cy").sortWithinPartitions("cx", "cy", "role", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, hit = None, None, np.zeros(0, bool)

        def close() -> Iterator[pa.RecordBatch]:
            if held is not None and hit.any():
                at = np.flatnonzero(hit)
                yield _batch(cx=np.full(len(at), here[0]), cy=np.full(len(at), here[1]), role=np.zeros(len(at), np.int32), node=held["node"][at], grp=held["grp"][at])

        for b in batches:
            cols = {c: b.column(c).to_numpy() for c in ("cx", "cy", "role", "node", "n", "grp")}
            cols["sig"] = _signatures(b.column("sig"))
            cut = np.flatnonzero(np.r_[True, (cols["cx"][1:] != cols["cx"][:-1]) | (cols["cy"][1:] != cols["cy"][:-1]), True]) if b.num_rows else []
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                spot = int(cols["cx"][x]), int(cols["cy"][x])
                if spot != here:
                    yield from close()
                    here, held, hit = spot, None, np.zeros(0, bool)
                z = x + int(np.searchsorted(cols["role"][x:y], 1))
                if z > x:
                    more = {c: v[x:z] for c, v in cols.items()}
                    held = more if held is None else {c: np.concatenate([held[c], more[c]]) for c in more}
                    hit = np.zeros(len(held["node"]), bool)
                if held is None or z == y:
                    continue
                good = np.zeros(y - z, bool)
                for i in range(z, y):
                    fit = (held["grp"] != cols["grp"][i]) & (np.minimum(held["n"], cols["n"][i]) * DENOMINATOR >= np.maximum(held["n"], cols["n"][i]) * NUMERATOR)
                    at = np.flatnonzero(fit)
                    if len(at):
                        at = at[np.count_nonzero(held["sig"][at] != cols["sig"][i], axis=1) <= THRESHOLD]
                        hit[at] = True
                        good[i - z] = len(at) > 0
                if good.any():
                    at = z + np.flatnonzero(good)
                    yield _batch(**{c: cols[c][at] for c in ("cx", "cy", "role", "node", "grp")})
        yield from close()

    return rows.select("cx", "cy", "role", "node", "n", "grp", "sig").mapInArrow(run, f"{CELL}, grp long")


def links(docs: DataFrame, nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Links (u, v) between the two sides of each cell, verified on full sets.

    ``cells`` is a stored table of cx, cy, role, node, grp; one link comes out for
    two groups that a cell joins. A text is sent once to each cell it is in.
    """
    found = bodies(docs, nodes, cells.select("node").distinct())
    rows = cells.join(found, "node").repartition("cx", "cy").sortWithinPartitions("cx", "cy", "role", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        here: tuple | None = None
        cell = Cell()
        for b in slices(batches, "body", 1 << 20):
            spots = list(zip(*(b.column(c).to_pylist() for c in ("cx", "cy")), strict=True))
            sets = shingle_sets(pa.array([unpack.decompress(x) for x in b.column("body").to_pylist()], pa.large_binary()))
            sig, role, node, grp = _signatures(b.column("sig")), *(b.column(c).to_pylist() for c in ("role", "node", "grp"))
            out = []
            for i, s in enumerate(spots):
                if s != here:
                    here, cell = s, Cell()
                if role[i] == 0:
                    cell.hold(node[i], grp[i], sig[i], sets[i])
                else:
                    out += cell.links(node[i], grp[i], sig[i], sets[i])
            if out:
                u, v = zip(*out, strict=True)
                yield _batch(u=np.array(u, np.int64), v=np.array(v, np.int64))

    return rows.select("cx", "cy", "role", "node", "grp", "sig", "body").mapInArrow(compare, "u long, v long")


class Cell:
    """Held sets, and the groups that links found here have joined."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.groups: list[int] = []
        self.sets: list[np.ndarray] = []
        self.sigs: list[np.ndarray] = []
        self.up: dict[int, int] = {}
        self.ready = False

    def hold(self, node: int, group: int, sig: np.ndarray, shingles: np.ndarray) -> None:
        self.nodes.append(node)
        self.groups.append(group)
        self.sets.append(shingles)
        self.sigs.append(sig)

    def root(self, g: int) -> int:
        while (up := self.up.get(g, g)) != g:
            self.up[g] = g = self.up.get(up, up)
        return g

    def prepare(self) -> None:
        self.sig, self.size = np.stack(self.sigs), np.array([len(s) for s in self.sets])
        self.group = np.array([self.root(g) for g in self.groups])
        flat = np.concatenate(self.sets)
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        by = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[by], owner[by]
        self.ready = True

    def links(self, node: int, group: int, sig: np.ndarray, shingles: np.ndarray) -> list[tuple[int, int]]:
        if not self.nodes:
            return []
        if not self.ready:
            self.prepare()
        n, mine = len(shingles), self.root(group)
        fit = (self.group != mine) & (np.minimum(self.size, n) * DENOMINATOR >= np.maximum(self.size, n) * NUMERATOR)
        at = np.flatnonzero(fit)
        at = at[np.count_nonzero(self.sig[at] != sig, axis=1) <= THRESHOLD] if len(at) else at
        if not len(at):
            return []
        if len(at) > 16:
            # intersections with all held sets at once, from the postings of the shingles
            lo, hi = np.searchsorted(self.flat, shingles, "left"), np.searchsorted(self.flat, shingles, "right")
            count = hi - lo
            spots = np.repeat(hi - np.cumsum(count), count) + np.arange(int(count.sum()))
            both = np.bincount(self.owner[spots], minlength=len(self.nodes))[at]
        else:
            both = np.array([len(np.intersect1d(self.sets[i], shingles, assume_unique=True)) for i in at])
        out = []
        for i in at[DENOMINATOR * both >= NUMERATOR * (self.size[at] + n - both)].tolist():
            a, b = self.root(int(self.group[i])), self.root(mine)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.group[self.group == max(a, b)] = min(a, b)
                out.append((max(node, self.nodes[i]), min(node, self.nodes[i])))
        return out


def bodies(docs: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, sig, body): zstd copies of the texts that stand for some nodes."""
    wanted = needed.join(nodes.select("node", "cls", "sig", F.col("first").alias("doc"), F.col("hash").alias("h")), "node")
    wanted = maybe_broadcast(stored(wanted, "mih-needed"), BROADCAST_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in slices(batches, "text"):
            same = [set_key(s) == c for s, c in zip(shingle_sets(b.column("text")), b.column("cls").to_pylist(), strict=True)]
            b = b.filter(pa.array(same, pa.bool_()))
            raw = b.column("text").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("sig"), pa.array([pack.compress(x) for x in raw], pa.binary())], names=["node", "sig", "body"])

    text = _rows(docs)
    found = text.join(wanted, (text["hash"] == F.col("h")) & text["doc_id"].eqNullSafe(F.col("doc"))).select("node", "cls", "sig", "text")
    return stored(found.mapInArrow(run, "node long, sig binary, body binary").dropDuplicates(["node"]), "mih-bodies")


def near_groups(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with what tells rows apart: text_hash, and the group as grp
    (null for the empty set).
    """
    sets = stored(sketch(docs), "mih-sketch")
    stands = F.struct(F.col("first").isNull().alias("z"), F.col("first"), F.col("hash"))
    classes = sets.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(stands).alias("r"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    # the number is written with the table, so it stays
    nodes = stored(classes.select("cls", "n", "sig", "r.first", "r.hash", F.monotonically_increasing_id().alias("node")), "mih-nodes")
    inner, heads = index(nodes)
    one = links(docs, nodes, stored(first_cells(inner, heads).withColumn("grp", F.col("node")), "mih-cells"))
    groups = components(one)
    near = settled(lambda: near_cells(open_cells(nodes, inner, heads, groups), nodes, groups), "mih-cells")
    final = components(links(docs, nodes, near), groups)
    # components are named by ids, which may be null or repeat, so last of all
    inside = final.union(final.select("root", "root").distinct()).join(nodes.select("node", "first"), "node")
    names = inside.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(inside.select("node", "root").join(names, "root"), "mih-named")
    parts = nodes.select("cls", "node", "first").join(maybe_broadcast(named, BROADCAST_ROWS), "node", "left")
    parts = parts.select("cls", F.coalesce("root", "node").alias("grp"), F.coalesce("component_id", "first").alias("component_id"))
    rows = sets.select("cls", "n", "rows").join(parts, "cls", "left").select(F.explode("rows").alias("r"), F.col("n").alias("n_shingles"), "component_id", "grp")
    component = F.when(F.col("n_shingles") == 0, F.col("r.doc_id")).otherwise(F.col("component_id"))
    return rows.select("r.doc_id", "n_shingles", component.alias("component_id"), F.col("r.doc_id").eqNullSafe(component).alias("kept"), "r.text_hash", "grp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of documents linked by shingle similarity of 0.75 or more.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are
    runs of bytes other than ASCII white space, A-Z lower-cased. Null and empty
    texts, and texts without words, have the empty set and stand alone; texts of
    fewer than five words have one shingle. Texts may have any length: a task holds
    one text, and a cell's sets of about CELL_SHINGLES shingles or one set more.

    Links are between texts, so rows that share a doc_id but not their text are
    documents of their own, which may be in different components. Rows without a
    doc_id take part with their text but never name a component; where no row of a
    component has an id, its name is null. Repeated rows share their component. An
    empty table gives an empty result. Returns one row per document: doc_id,
    n_shingles, component_id, kept.
    """
    return near_groups(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that which names it.

    All columns stay. Rows with the empty set all stay. Of several rows with the
    component's id, or of a component without ids, the longest text stays; of rows
    that repeat, one.
    """
    return one_of_each(docs, near_groups(docs), BROADCAST_ROWS)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
