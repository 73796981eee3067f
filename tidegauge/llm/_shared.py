"""Helpers that the operators share: folders, Arrow columns, word hashing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

# Rows of text are handed to numpy in slices of about this many bytes.
SLICE_BYTES = 512 << 10

# ASCII white space as the contracts define it: space and 9 to 13.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


# ------------------------------------------------------------------ folders
def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    A lost executor then costs a re-read of files, not a re-run of what came
    before. ``drop_scratch`` removes the folder when results were consumed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[str] = []  # folders that ``stored`` wrote, in order


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` gives, stored; the tables that were stored on the way go.

    Nothing that was made before may be read from those tables later.
    """
    before = len(_made)
    out = stored(make(), tag)
    for path in _made[before:-1]:
        remove(out.sparkSession, path)
    del _made[before:-1]
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table this application stored in the shared folder."""
    remove(spark, shared_dir(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a stored table only where its row count is checked."""
    return F.broadcast(df) if bounded(df, rows) else df


def fresh(columns: list[str], count: int) -> list[str]:
    """Names that no column has, whatever the case."""
    taken, out, i = {c.lower() for c in columns}, [], 0
    while len(out) < count:
        if f"_{i}" not in taken:
            out.append(f"_{i}")
        i += 1
    return out


def text_hash(column: str | Column = "text") -> Column:
    """With the doc_id, what tells a row from others that share its id."""
    return F.xxhash64(F.col(column).cast("string") if isinstance(column, str) else column)


def one_of_each(docs: DataFrame, marked: DataFrame, rows: int) -> DataFrame:
    """Rows of ``docs`` of which ``marked`` says that they are kept, one of each group.

    ``marked`` has doc_id, text_hash, kept and grp (null: on its own) for every row.
    Rows are told apart by id and text, so ids that repeat or are missing do no
    harm. Where several rows of a group are kept alike (rows that repeat, or have
    no id), the longest text stays, then the largest; of rows that are equal, one.
    Marks are broadcast where they have at most ``rows`` rows.
    """
    marked = stored(marked.select("doc_id", "text_hash", "kept", "grp"), "marked")
    kept = marked.filter("kept AND grp IS NOT NULL")
    several = stored(kept.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1").select("grp"), "tied")
    ties = kept.join(maybe_broadcast(several, rows), "grp").select("doc_id", "text_hash", "grp")
    gone = marked.filter("NOT kept").select("doc_id", "text_hash", F.lit(None).cast(marked.schema["grp"].dataType).alias("grp"))
    marks = stored(gone.union(ties).distinct(), "marks")
    key, doc, text, grp, hit, row = fresh(docs.columns, 6)
    marks = marks.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("grp").alias(grp), F.lit(1).alias(hit))
    keyed = docs.withColumn(key, text_hash())
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text))
    joined = keyed.join(maybe_broadcast(marks, rows), same, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = joined.filter(F.col(hit).isNull()).select(columns)
    if several.isEmpty():
        return rest
    order = F.struct(F.length("text"), F.col("text"), F.xxhash64(*columns))
    best = joined.filter(F.col(grp).isNotNull()).groupBy(grp).agg(F.max_by(F.struct(columns), order).alias(row))
    return rest.union(best.select(f"{row}.*"))


# ------------------------------------------------------------- Arrow columns
def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one flat byte array and n + 1 offsets; null is empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    if len(col) == 0 or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each piece.

    A single longer row forms a piece of its own.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offs = text_bytes(batch.column(column))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, min(to, n) - at)
            at = min(to, n)


def texts(col: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty string."""
    return [x or "" for x in col.to_pylist()]


def blobs(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in col.cast(pa.large_binary()).to_pylist()]


# ------------------------------------------------------------- word hashing
_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for base in (_MULT, _INV):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POWERS.append(np.multiply.accumulate(p))
            del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


SPACE_MASK = np.zeros(256, bool)
SPACE_MASK[list(SPACE_BYTES)] = True


def word_spans(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE_MASK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of maximal runs of bytes outside ``gap``.

    Runs never cross a row's end.
    """
    word = ~gap[data]
    if not len(word):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] = word[heads]
    tails = offs[1:][offs[:-1] < offs[1:]] - 1
    last[tails] = word[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


# Polynomials modulo 2**64 collide on built strings of a thousand letters; spans
# beyond this many bytes are hashed one by one.
LONG_SPAN = 64


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, from prefix sums of a polynomial."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            base = int(starts[at])
            to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            end = int(ends[to - 1])
            power, inverse = _powers(end - base + 1)
            sums = np.zeros(end - base + 1, np.uint64)
            np.cumsum(_BYTE[data[base:end]] * power[: end - base], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = mix64((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * _MULT + words[i : i + n]
        return mix64(out)
