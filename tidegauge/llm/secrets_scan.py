"""Secret scans with multipart credential linking.

Strong findings stand alone. Parts that are weak alone (short access ids, client
ids, high-entropy strings, endpoints) are reported only where complementary
parts lie in one scope: an interval join between identifiers, secrets and
endpoints whose spans are at most ``REACH`` code points apart within the same
paragraph.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import slices, table, texts

# The base kinds, in their listed order, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 12
# Maximal runs of the class: runs below the least length need not be visited.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Parts of a credential that are weak alone.
WEAK_ID = re.compile(r"\bAKIA[A-Z0-9]{4,13}\b|\b(?:client_?id|user(?:name)?|login|account)[\"']?\x20?[:=]\x20?[\"']?([A-Za-z0-9_.@-]{3,64})", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", re.ASCII)
ENDPOINT = re.compile(r"\b(?:https?|s3|ftp|jdbc|mongodb|postgres(?:ql)?|mysql|redis|amqp)://[^\s\"'<>]{4,}", re.IGNORECASE | re.ASCII)
EXTRA = ("linked_id", "linked_secret", "linked_endpoint")
ORDER = {k: i for i, k in enumerate(KINDS + EXTRA)}
REACH = 240
ENTROPY = 3.5  # bits a character that a weak secret must have

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds: leftmost, not overlapping within a kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def mixed(s: str) -> bool:
    """Letters of either case and digits: prose and numbers aren't secrets."""
    return any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)


def near(spans: list[Span], start: int, end: int, scope: tuple[int, int], reach: int) -> list[Span]:
    """Spans (sorted) within ``reach`` of [start, end) inside the scope."""
    lo = max(scope[0], start - reach)
    # spans don't overlap within a role, so the ends are sorted too
    at = bisect_left(spans, lo, key=lambda s: s[1])
    out = []
    while at < len(spans) and spans[at][0] <= min(scope[1], end + reach):
        if (spans[at][0], spans[at][1]) != (start, end) and spans[at][0] >= scope[0]:
            out.append(spans[at])
        at += 1
    return out


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that meet their complement.

    A weak identifier needs a secret (weak or base) near it; a weak secret needs
    an identifier (weak or base) and is no part of a base span; an endpoint needs
    both an identifier and a secret. Scopes are paragraphs: blank lines part them.
    """
    ids = [(m.start(), m.end(), "linked_id") for m in WEAK_ID.finditer(text)]
    strong_ids = [s for s in base if s[2] == "access"]
    if not ids and not strong_ids:
        return []
    strong = [s for s in base if s[2] != "access"]
    cover = sorted((s[0], s[1]) for s in base)
    ends: list[int] = []
    for _, b in cover:
        ends.append(max(b, ends[-1] if ends else 0))

    def covered(a: int, b: int) -> bool:
        i = bisect_left(cover, (b, 0))
        return i > 0 and ends[i - 1] > a

    secrets = [(m.start(), m.end(), "linked_secret") for m in WEAK_SECRET.finditer(text) if mixed(m[0]) and entropy(m[0]) >= ENTROPY and not covered(m.start(), m.end())]
    points = [(m.start(), m.end(), "linked_endpoint") for m in ENDPOINT.finditer(text)]
    breaks = [-1, *(m.start() for m in re.finditer(r"\n\s*\n", text)), len(text) + 1]

    def scope(at: int) -> tuple[int, int]:
        i = bisect_left(breaks, at + 1)
        return max(0, breaks[i - 1]), breaks[i]

    by_role = {"id": sorted(ids + strong_ids)}
    weak, hard = sorted(secrets), sorted(strong)
    # strong spans of two kinds may overlap: their ends are not sorted, so each kind is searched apart
    kinds = [weak, *([s for s in hard if s[2] == k] for k in ("assign", "hex"))]

    def secret_near(a: int, b: int) -> bool:
        return any(near(k, a, b, scope(a), reach) for k in kinds)

    def id_near(a: int, b: int) -> bool:
        return any(near(k, a, b, scope(a), reach) for k in (sorted(ids), strong_ids))

    out = [s for s in by_role["id"] if s[2] == "linked_id" and secret_near(s[0], s[1]) and not covered(s[0], s[1])]
    out += [s for s in weak if id_near(s[0], s[1])]
    out += [s for s in points if id_near(s[0], s[1]) and secret_near(s[0], s[1])]
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[0], ORDER[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """All spans of every whole text: doc_id, base and spans (arrays of structs).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts have no spans. Offsets are code points, ends exclusive. One row
    per row; a scope is a paragraph of one text, so nothing is shuffled.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [all_spans(t) for t in texts(b.column("text"))]
            cols = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in f[i]] for f in found], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "base", "spans"])

    kind = "array<struct<start:long,end:long,kind:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of secret spans of ``text`` replaced by ``mark``.

    All columns stay; ``n_chars``, where present, counts the new text. Null text
    stays null.
    """
    order = docs.columns

    def clean(text: str) -> str:
        spans = all_spans(text)[1]
        if not spans:
            return text
        out, at = [], 0
        for a, b, _ in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            new = [None if t is None else clean(t) for t in b.column("text").to_pylist()]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in order:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(order)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
