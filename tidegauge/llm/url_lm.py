"""URL filters: rules first, then a ratio of two character language models.

Two variable-order Markov models over bytes, of URLs that rules allow and that
rules block, give each other URL a log-likelihood difference per character. Its
threshold is calibrated on rows that the models did not count.

Counts cover all rows that a rule judges. They are exact: each n-gram is its own
key, so no two share a counter. A table of up to ``BROADCAST_GRAMS`` n-grams is sent
to the tasks; a larger one stays where it is, and each block of URLs is joined with
the n-grams that it has.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._shared import blobs, bounded, slices, stored, table

# The rules of the query, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 4  # characters of context at most
WEIGHT = 4.0  # pseudo-counts that a shorter context gets
BINS = 2001  # of the calibration histogram over [-LIMIT, LIMIT]
LIMIT = 8.0
START, END = 2, 3
BROADCAST_GRAMS = 4_000_000  # n-grams with their counts: 96 MB
BLOCK_BYTES = 64 << 10  # URLs that are joined with their n-grams together


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Number of the longest rule that fits, or null."""
    ranked = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    out = F.lit(None).cast("int")
    for i in reversed(ranked):
        _, h, p = rules[i]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(out)
    return out


def ngram_keys(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that end at each character: context length x positions;
    and the number of the URL at each position.

    A key holds the bytes themselves, the last one lowest, and the length of the
    context above them; without its lowest byte it is the key of the context.
    """
    raw = b"".join(bytes([START]) * ORDER + u + bytes([END]) for u in urls)
    flat = np.frombuffer(raw, np.uint8).astype(np.int64)
    size = np.array([len(u) + 1 for u in urls], np.int64)
    row = np.repeat(np.arange(len(urls)), size + ORDER)
    head = np.repeat(np.cumsum(size + ORDER) - size - ORDER, size + ORDER)
    at = np.flatnonzero(np.arange(len(flat)) - head >= ORDER)
    out = np.zeros((ORDER + 1, len(at)), np.int64)
    text = np.zeros(len(at), np.int64)
    for n in range(ORDER + 1):
        text |= flat[at - n] << (8 * n)
        out[n] = text | n << (8 * (ORDER + 1))
    return out, row[at]


def look_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts (label x key) of the wanted keys; 0 for those that are not there."""
    if not len(keys):
        return np.zeros((len(counts), len(wanted)))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[:, at], 0).astype(np.float64)


def difference(urls: list[bytes], look: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log-likelihood difference per character of two smoothed models.

    ``look`` gives label x key counts of n-grams, and of their contexts. Positive:
    more like the accepted ones.
    """
    if not urls:
        return np.zeros(0)
    grams, row = ngram_keys(urls)
    p = np.full((2, len(row)), 1 / 256)
    for key in grams:
        # most positions repeat: each distinct n-gram is looked up once
        once, at = np.unique(key, return_inverse=True)
        seen, before = look(once)
        p = (seen[:, at] + WEIGHT * p) / (before[:, at] + WEIGHT)
    return np.bincount(row, np.log(p[0]) - np.log(p[1]), len(urls)) / np.bincount(row, minlength=len(urls))


class Ratio:
    """Both models in memory."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """Ascending keys of n-grams, and label x key counts."""
        self.keys, self.counts = keys, counts
        heads = np.flatnonzero(np.r_[True, np.diff(keys >> 8) != 0][: len(keys)])
        self.contexts = keys[heads] >> 8
        self.totals = np.add.reduceat(counts, heads, axis=1) if len(keys) else counts

    def score(self, urls: list[bytes]) -> np.ndarray:
        return difference(urls, lambda once: (look_up(self.keys, self.counts, once), look_up(self.contexts, self.totals, once >> 8)))


COUNTS = ("n0", "n1", "n2", "n3")  # of fold 0 accepted and rejected, then fold 1


def gram_table(labelled: DataFrame) -> DataFrame:
    """Counts of all n-grams: gram, and a column for each fold and label.

    ``labelled`` has url, label (0 accepted, 1 rejected) and fold (0 or 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "url"):
            grams, row = ngram_keys(blobs(b.column("url")))
            label, fold = (np.array(b.column(c).to_pylist(), np.int64) for c in ("label", "fold"))
            kind = (2 * fold + label)[row]
            keys, at = np.unique(grams, return_inverse=True)
            n = np.bincount((at.reshape(grams.shape) * 4 + kind).ravel(), minlength=4 * len(keys)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(n[:, i]) for i in range(4))], names=["gram", *COUNTS])

    got = labelled.select("url", "label", "fold").mapInArrow(run, "gram long, n0 long, n1 long, n2 long, n3 long")
    return got.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def count_grams(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The same in memory: ascending keys, and fold x label x key counts."""
    return gathered(gram_table(labelled))


def gathered(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = grams.toArrow()
    keys = got.column("gram").to_numpy()
    by = np.argsort(keys)
    return keys[by], np.stack([got.column(c).to_numpy()[by] for c in COUNTS]).reshape(2, 2, -1)


Scorer = Callable[[DataFrame], DataFrame]  # adds a column score to rows with a url


def in_memory(keys: np.ndarray, counts: np.ndarray) -> Scorer:
    """Scores by models that every task holds."""

    def add(rows: DataFrame) -> DataFrame:
        model = rows.sparkSession.sparkContext.broadcast(Ratio(keys, counts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "url"):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.score(blobs(b.column("url"))), pa.float64())], names=[*b.schema.names, "score"])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))

    return add


def by_join(grams: DataFrame, accepted: Column, rejected: Column) -> Scorer:
    """Scores by a stored table of n-grams: each block of URLs meets those it has.

    A block's own n-grams are bounded by its bytes, so a task holds no more.
    """
    counts = grams.select("gram", accepted.alias("c0"), rejected.alias("c1"))
    totals = counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    numbers = ["gram", "c0", "c1", "t0", "t1"]

    def add(rows: DataFrame) -> DataFrame:
        schema = rows.schema

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId() << 32
            for i, b in enumerate(slices(batches, "url", BLOCK_BYTES)):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part + i))], names=[*b.schema.names, "block"])

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block, urls = b.column("block").to_numpy(), blobs(b.column("url"))
                cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else []
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    keys = np.unique(ngram_keys(urls[x:y])[0])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block[x])), pa.array(keys)], names=["block", "gram"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, held = None, []
            for b in batches:
                block, kind = b.column("block").to_numpy(), b.column("kind").to_numpy()
                cut = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), True]) if len(block) else []
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    if block[x] != here:
                        here, held = block[x], []
                    part = b.slice(x, y - x)
                    if kind[x] == 0:
                        held.append([part.column(c).to_numpy() for c in numbers])
                        continue
                    key, *n = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(key)
                    key, n = key[order], np.stack(n)[:, order]
                    scores = difference(blobs(part.column("url")), lambda once: (look_up(key, n[:2], once), look_up(key, n[2:], once)))  # noqa: B023
                    yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema), pa.array(scores, pa.float64())], names=[*schema.names, "score"])

        dealt = stored(rows.mapInArrow(deal, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, block long"), "url-blocks")
        asked = dealt.select("block", "url").mapInArrow(wanted, "block long, gram long").distinct()
        known = asked.join(counts, "gram", "left").join(totals, F.shiftright("gram", 8) == F.col("context"), "left")
        known = known.select("block", F.lit(0).alias("kind"), "gram", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers[1:]), *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        urls = dealt.select("block", F.lit(1).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in numbers), *schema.names)
        both = known.union(urls).repartition("block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))

    return add


def calibrate(labelled: DataFrame, add: Scorer, fold: int) -> float:
    """The threshold with the least balanced error on rows of a fold."""
    scored = add(labelled.filter(F.col("fold") == fold).select("url", "label"))
    at = F.rint((F.col("score") + LIMIT) / (2 * LIMIT) * (BINS - 1))
    at = F.least(F.greatest(at, F.lit(0.0)), F.lit(BINS - 1.0)).cast("long")
    got = scored.groupBy((F.col("label") * BINS + at).alias("bin")).agg(F.count("*").alias("n")).toArrow()
    hist = np.zeros(2 * BINS)
    hist[got.column("bin").to_numpy()] = got.column("n").to_numpy()
    accepted, rejected = hist[:BINS], hist[BINS:]
    if not accepted.sum() or not rejected.sum():
        return 0.0
    # threshold below bin i: accepted ones below it and rejected ones from it on are errors
    wrong = np.r_[0, np.cumsum(accepted)] / accepted.sum() + (rejected.sum() - np.r_[0, np.cumsum(rejected)]) / rejected.sum()
    best = np.flatnonzero(wrong == wrong.min())
    return float((best[len(best) // 2] - 0.5) / (BINS - 1) * 2 * LIMIT - LIMIT)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """A verdict for every url: that of the longest rule that fits, else the models'.

    ``pages`` needs ``page_id`` and ``url``; other columns are ignored. Null
    urls, and those without ``://``, have an empty host and path and are judged
    by the models on what text they have; the empty url is allowed, as is every
    url where rules give no row for one of the models. A score at the threshold is
    allowed. Urls may have any length; repeated rows are judged and counted each. Returns page_id, host,
    path, rule, verdict, score (null where a rule decides).
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    blocked = F.col("hit").isin([i for i, r in enumerate(rules) if r[0] == "block"])
    labelled = rows.filter("hit IS NOT NULL").select("url", blocked.cast("int").alias("label"), F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(2)).cast("int").alias("fold"))
    grams = stored(gram_table(labelled), "url-grams")
    sums = grams.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS)).first()
    names = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        names = F.when(F.col("hit") == i, F.lit(r[1] + r[2])).otherwise(names)
    judged = rows.select("page_id", "url", "host", "path", names.alias("rule"), blocked.alias("blocked"))
    if not (sums[0] + sums[2] and sums[1] + sums[3]):  # no row for one of the models
        likely, scored = F.lit(True), judged.withColumn("score", F.lit(0.0))
    else:
        if bounded(grams, BROADCAST_GRAMS):
            keys, counts = gathered(grams)
            first, every = in_memory(keys, counts[0]), in_memory(keys, counts.sum(axis=0))
        else:
            first = by_join(grams, F.col("n0"), F.col("n1"))
            every = by_join(grams, F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3"))
        threshold = calibrate(labelled, first, 1) if all(sums[:2]) else 0.0
        likely, scored = (F.length(F.coalesce("url", F.lit(""))) == 0) | (F.col("score") >= threshold), every(judged)
    verdict = F.when(F.coalesce(~F.col("blocked"), likely), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
