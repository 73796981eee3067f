"""BPE encoding and decoding by batched numpy merge rounds.

The distinct words of a slice of rows lie in one flat symbol array, with the rank
of every adjacent pair, found by binary search over the sorted pair keys. A round
takes each word's lowest rank and merges all its occurrences at once; only pairs
next to a merge are looked up again, and words without a known pair leave. Words
that are left after ``LATE`` rounds are long: they go on in rounds over one rank
each, lowest first, which touch only the places of that rank. So the work grows
with the merges, not with a word's length times its merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers

from ._shared import slices, table, texts

CACHE_WORDS = 300_000  # words whose ids a task remembers; beyond, it starts anew
CACHE_LETTERS = 200  # of a word that is remembered
LATE = 64
ROUND_BYTES = 4 << 20  # bytes of distinct words merged together
NONE = np.int32(2**31 - 1)
_MODELS: dict[str, WordBPE] = {}


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBPE:
    """A BPE file with word ends, lower-casing and a word pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: list[str] = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for s, i in (vocab | self.specials).items():
            self.strings[i] = s
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.final = np.array([vocab[c + self.end] for c in alphabet], np.int32)
        merges = spec["model"]["merges"]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = pattern
        self.split = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        # special tokens are bytes here, so no word equals them
        self.known: dict[str | bytes, bytes] = {}
        # classes and lower case of characters as the library's Unicode tables have them
        self.classes = {k: set() for k in (r"\p{L}", r"\p{N}", r"\s")}
        self.seen: set[str] = set()
        self.odd: dict[int, str] = {}
        self.blocks: set[int] = set()
        self.learn({chr(c) for c in (*range(0x530), *range(0x2000, 0x2070), 0x3000)})
        self.ascii_words = self.spelled(str.isascii)

    def around(self, chars: set[str]) -> set[str]:
        """The blocks of 4096 code points of these characters; after eight, all."""
        self.blocks |= {ord(c) >> 12 for c in chars}
        blocks = range(0x110) if len(self.blocks) > 8 else self.blocks
        return {chr(c) for b in blocks for c in range(b << 12, (b + 1) << 12) if not 0xD800 <= c < 0xE000} | chars

    def learn(self, chars: set[str]) -> None:
        """Ask the library for classes and lower case of new characters."""
        lower = normalizers.Lowercase()
        small = {c: lower.normalize_str(c) for c in chars}
        self.odd |= {ord(c): s for c, s in small.items() if s != c.lower()}
        pool = "".join(chars | {c for s in small.values() for c in s})
        self.seen |= set(pool)
        for name, known in self.classes.items():
            rest = normalizers.Replace(Regex(f"[{name}]"), "").normalize_str(pool)
            known |= set(pool) - set(rest)
        self.words = self.spelled(lambda c: True)

    def spelled(self, keep: Callable[[str], bool]) -> re.Pattern:
        """The pattern with its classes written out, as far as characters are to be kept."""
        out = self.pattern
        for name, known in self.classes.items():
            out = out.replace(name, "".join(map(re.escape, sorted(filter(keep, known)))))
        return re.compile(out)

    def pieces(self, text: str) -> list[str | bytes]:
        """Words of a text; special tokens stand as they are in the text."""
        if self.split is not None and "<|" in text:
            return [w for part in self.split.split(text) for w in ([part.encode()] if part in self.specials else self.pieces_plain(part))]
        return self.pieces_plain(text)

    def pieces_plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        # Lower-casing goes letter by letter: no final form of sigma.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if new := set(text) - self.seen:
            self.learn(self.around(new))
        if self.odd:
            text = text.translate(self.odd)
        return self.words.findall(text.lower())

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE where there is no merge."""
        pair = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def rounds(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self.find(sym[:-1], sym[1:])
        rank[ends - 1] = NONE
        done_sym, done_word = [], []
        for _ in range(LATE):
            if not len(sym):
                break
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(sym)]))
            live = lowest != NONE
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            hit = self.alternate(np.flatnonzero((rank == lowest) & live), 1)
            sym[hit] = self.merged[rank[hit]]
            live[hit + 1] = False
            place = (np.cumsum(live) - 1)[hit]
            sym, word, rank = sym[live], word[live], rank[live]
            # the merged symbol has a new pair with either neighbour
            place = np.unique(np.r_[place, place[place > 0] - 1])
            inner = place[place + 1 < len(sym)]
            rank[place] = NONE
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.find(sym[inner], sym[inner + 1])
        if len(sym):
            sym, word = self.late(sym, word, rank)
            done_sym.append(sym)
            done_word.append(word)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        ids = sym[order].astype("<u4").tobytes()
        cut = np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))] * 4
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    @staticmethod
    def alternate(hit: np.ndarray, after: np.ndarray | int) -> np.ndarray:
        """Hits that merge: in a run of them (a pair of equal symbols) every other one.

        ``after`` is the place next to each hit, or the distance to it.
        """
        if not len(hit):
            return hit
        after = hit + after if isinstance(after, int) else after
        fresh = np.r_[True, hit[1:] != after[:-1]]
        run = np.arange(len(hit)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        return hit[run % 2 == 0]

    def late(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, one rank of all words a round.

        Neighbours are linked, so a merge moves nothing; places wait by rank.
        """
        n = len(sym)
        edge = np.r_[word[1:] != word[:-1], True]
        after = np.where(edge, n, np.arange(1, n + 1))
        before = np.where(np.r_[True, edge[:-1]], n, np.arange(-1, n - 1))
        after, before, sym = np.r_[after, n], np.r_[before, n], np.r_[sym, -1]
        alive = np.ones(n, bool)
        rank = np.r_[rank, NONE]
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[rank[at] != NONE]
            if not len(at):
                return
            by = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.r_[True, np.diff(rank[by]) != 0])
            for r, part in zip(rank[by[cut]].tolist(), np.split(by, cut[1:]), strict=True):
                if r in waiting:
                    waiting[r].append(part)
                else:
                    waiting[r] = [part]
                    heapq.heappush(ranks, r)

        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            hit = hit[rank[hit] == r]  # symbols that merged since have another rank
            hit = self.alternate(hit, after[hit])
            if not len(hit):
                continue
            gone = after[hit]
            sym[hit] = self.merged[r]
            alive[gone] = False
            rank[gone] = NONE
            after[hit] = after[gone]
            before[after[hit]] = hit
            before[n] = n
            changed = np.unique(np.r_[hit, before[hit]])
            changed = changed[changed < n]
            rank[changed] = NONE
            inner = changed[after[changed] < n]
            rank[inner] = self.find(sym[inner], sym[after[inner]])
            wait(inner)
        return sym[:n][alive], word[alive]

    def encode_words(self, words: set[str]) -> None:
        """Remember the ids of new words."""
        block: list[str] = []
        size = 0
        for w in sorted(words):
            block.append(w)
            size += 4 * len(w)
            if size > ROUND_BYTES:
                self.known.update(zip(block, self.rounds(block), strict=True))
                block, size = [], 0
        if block:
            self.known.update(zip(block, self.rounds(block), strict=True))

    def encode_batch(self, rows: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.pieces(t) for t in rows]
        known = self.known
        known.update({s.encode(): i.to_bytes(4, "little") for s, i in self.specials.items()})
        wanted: set[str | bytes] = set()
        for ws in split:
            wanted.update(ws)
        fresh = wanted.difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            fresh = {w for w in wanted if isinstance(w, str)}
            known.clear()
            known.update({s.encode(): i.to_bytes(4, "little") for s, i in self.specials.items()})
        self.encode_words(fresh)
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for w in fresh:
            if len(w) > CACHE_LETTERS:  # of any length, and not to be met again
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """Token strings joined by spaces: what the library does for a file without a decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def model(path: str) -> WordBPE:
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null and empty give no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = model(path).encode_batch(texts(b.column("text")))
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            offs = pa.array(np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offs, flat)], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model(path)
            out = [m.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text; return sizes and digests of both.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts have no tokens and decode to the empty text. One row per row, in
    one pass without a shuffle: a task holds a slice of rows and its cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            m = model(path)
            ids = m.encode_batch(texts(b.column("text")))
            cols = [
                b.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(m.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
