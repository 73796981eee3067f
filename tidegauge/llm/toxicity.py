"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a logistic score over hashed
words and word beginnings; the document's is their noisy-or, ``1 - prod(1 - p)``, so that labels of
documents alone train the sentence scores, which then locate the sentences. In
scoring, what clean sentences are expected to add is taken off, so that length
alone is no evidence.

The model is fitted on a bounded sample of labelled rows of any length
(``SAMPLE_ROWS`` rows, and none after ``SAMPLE_BYTES`` bytes of text); scoring
covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lower_ascii, mix64, slices, span_hashes, stored, table, text_bytes, word_spans

SAMPLE_ROWS = 10_000
SAMPLE_BYTES = 64 << 20  # the row that passes it is the last one
FEATURES = 2048  # words and prefixes with a weight of their own
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that are features too: stems under other endings
ROUNDS = 300
SAFETY = 4.0  # clean sentences of other texts add more than those of the sample

# letters of ASCII and every byte of other characters form words
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
STOPS = np.zeros(256, bool)
STOPS[list(b".!?\n")] = True


@dataclass
class Bag:
    """Words of a slice of rows, in order: sentence (numbered through), row, bytes."""

    low: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of words and of their first PREFIXES bytes, and whose word each is."""
        hashes, owner = [span_hashes(self.low, self.start, self.end)], [np.arange(len(self.start))]
        for n in PREFIXES:
            at = np.flatnonzero(self.end - self.start > n)
            with np.errstate(over="ignore"):
                hashes.append(mix64(span_hashes(self.low, self.start[at], self.start[at] + n) + np.uint64(n)))
            owner.append(at)
        return np.concatenate(hashes), np.concatenate(owner)

    def heads(self) -> np.ndarray:
        """First word of each sentence."""
        return np.flatnonzero(np.r_[True, np.diff(self.sentence) != 0])[: len(self.sentence)]


def bag(col: pa.Array) -> tuple[Bag, np.ndarray]:
    """The words of a column, and the byte offsets of its rows."""
    data, offs = text_bytes(col)
    low = lower_ascii(data)
    starts, ends, row = word_spans(low, offs, NO_LETTER)
    # a sentence ends at a stop or with its row
    key = np.r_[0, np.cumsum(STOPS[data])][starts] + row
    sentence = np.cumsum(np.r_[0, np.diff(key) != 0]) if len(key) else key
    return Bag(low, sentence, row, starts, ends), offs


@dataclass
class Model:
    """Sorted feature hashes with their weights, the bias of a sentence, and what
    a sentence that is not offending may add to -log(1 - score) by chance.
    """

    features: np.ndarray
    weights: np.ndarray
    bias: float
    background: float = 0.0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are features, and which ones they are."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == h)
        return hit, at[hit]

    def hits(self, got: Bag) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, feature) pairs, once each."""
        h, owner = got.features()
        hit, what = self.find(h)
        pairs = np.unique(got.sentence[owner[hit]] * max(1, len(self.features)) + what)
        return pairs // max(1, len(self.features)), pairs % max(1, len(self.features))


def noisy_or(z: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) by row, from sums of log(1 - p) = -softplus(z)."""
    return -np.expm1(-np.bincount(row, np.logaddexp(0, z), rows))


def document_scores(z: np.ndarray, row: np.ndarray, rows: int, background: float) -> np.ndarray:
    """Noisy-or by row of the sentences with p >= 0.5, whatever the text's length,
    and of the others together as far as they exceed the background.
    """
    e = np.logaddexp(0, z)
    weak = np.bincount(row, np.where(z < 0, e - background, 0), rows)
    return -np.expm1(-np.bincount(row, np.where(z < 0, 0, e), rows) - np.maximum(weak, 0))


def fit(features: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], s_row: np.ndarray, bare: np.ndarray, label: np.ndarray) -> Model:
    """Weights that make the noisy-or of each row likely; Adam over the whole sample.

    ``pairs`` are (sentence, feature); ``s_row`` is the row of each sentence that has
    a feature, ``bare`` the number of a row's sentences without any.
    """
    n, y = len(label), label.astype(float)
    if not n or y.min() == y.max():
        return Model(features[:0], np.zeros(0), 40.0 if n and y.min() == 1 else -40.0)
    s_of, f_of = pairs
    w, b = np.zeros(len(features)), -5.0
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(s_of, w[f_of], len(s_row))
        p, p0 = sigmoid(z), sigmoid(b)
        clean = np.bincount(s_row, np.logaddexp(0, z), n) + bare * np.logaddexp(0, b)
        doc = np.clip(-np.expm1(-clean), 1e-9, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - doc) / doc, 1.0)
        each = pull[s_row] * p
        g = np.r_[np.bincount(f_of, each[s_of], len(features)) + 0.02 * w, each.sum() + (pull * bare).sum() * p0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], min(b - step[-1], -2.0)
    keep = np.abs(w) > 1e-3
    z = b + np.bincount(s_of, np.where(keep, w, 0)[f_of], len(s_row))
    weak = (y[s_row] == 0) & (z < 0)
    plain = bare[y == 0].sum()  # the bias is below 0
    background = (np.logaddexp(0, z[weak]).sum() + plain * np.logaddexp(0, b)) / max(1, weak.sum() + plain)
    return Model(features[keep], w[keep], float(b), float(SAFETY * background))


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 holds a row out of training."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows outside the held-out fifth, of any length.

    Labels without an id or a value, and those of ids that ``docs`` does not hold,
    are no labels; an id with several counts as toxic if one of them says so. The
    sample is by hash of the id and the text, so it does not depend on how rows are
    dealt; repeated rows are drawn once.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna()
    known = known.filter(remainder() != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # labels of other tables leave before the sample is drawn: only ids are joined here
    known = known.join(text.select("doc_id").dropna(), "doc_id", "left_semi")
    sample = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxic-sample")
    found = stored(text.join(F.broadcast(sample), "doc_id").withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)), "key": F.xxhash64("text")}), "toxic-texts")
    # by the same hash order, up to the row with which the text passes its bound;
    # an id may have many texts, so the rows are bounded again
    by = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("key")]
    sizes = found.groupBy("doc_id", "key").agg(F.max("size").alias("size")).orderBy(*by).limit(rows).toArrow()
    total = np.cumsum(sizes.column("size").to_numpy())
    most = int(np.searchsorted(total, SAMPLE_BYTES)) + 1
    ids = found.sparkSession.createDataFrame([(int(i), int(k)) for i, k in zip(*(sizes.column(c).to_pylist()[:most] for c in ("doc_id", "key")), strict=True)], "doc_id long, key long")
    chosen = stored(found.drop("size").join(F.broadcast(ids), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).drop("key"), "toxic-chosen")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got, _ = bag(b.column("text"))
            h, owner = got.features()
            y = b.column("y").to_numpy()
            by = np.lexsort((got.row[owner], h))
            h, row = h[by], got.row[owner][by]
            once = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])][: len(h)]
            h, row = h[once], row[once]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
            df = np.diff(np.r_[head, len(h)])
            pos = np.add.reduceat(y[row], head) if len(h) else df
            yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(df, pa.int64()), pa.array(pos, pa.int64())], names=["h", "df", "pos"])

    total = chosen.agg(F.count("*"), F.avg("y")).first()
    rate = total[1] or 0.0
    if not total[0] or rate in (0.0, 1.0):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 40.0 if rate == 1 else -40.0)
    counts = chosen.select("text", "y").mapInArrow(count, "h long, df long, pos long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("pos").alias("pos"))
    strength = F.abs(F.col("pos") - F.col("df") * rate) / F.sqrt(F.col("df") * (rate * (1 - rate)))
    top = counts.filter(F.col("df") >= 3).orderBy(strength.desc(), "h").limit(FEATURES).select("h").toArrow()
    features = np.sort(top.column("h").to_numpy().astype(np.int64).view(np.uint64))
    probe = Model(features, np.zeros(len(features)), 0.0)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got, _ = bag(b.column("text"))
            heads = got.heads()
            sentence, what = probe.hits(got)
            cut = np.searchsorted(got.row[heads][sentence], np.arange(b.num_rows + 1)).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (sentence, what)]
            n = np.bincount(got.row[heads], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(n, pa.int64()), *arrays], names=["doc_id", "y", "n", "sentence", "feature"])

    got = chosen.select("doc_id", "y", "text").mapInArrow(sparse, "doc_id long, y int, n long, sentence array<int>, feature array<int>").toArrow().combine_chunks()
    got = got.sort_by([("doc_id", "ascending"), ("n", "ascending")])
    inner, what = (got.column(c).combine_chunks() for c in ("sentence", "feature"))
    row = np.repeat(np.arange(got.num_rows), pc.list_value_length(inner).to_numpy())
    inner, what = inner.flatten().to_numpy().astype(np.int64), what.flatten().to_numpy().astype(np.int64)
    fresh = np.r_[True, (np.diff(inner) != 0) | (np.diff(row) != 0)][: len(inner)]
    s_row = row[fresh]
    bare = got.column("n").to_numpy() - np.bincount(s_row, minlength=got.num_rows)
    return fit(features, (np.cumsum(fresh) - 1, what), s_row, bare, got.column("y").to_numpy())


def sentence_scores(got: Bag, model: Model, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of sentences, their first words, and the score of each row."""
    heads = got.heads()
    sentence, what = model.hits(got)
    z = model.bias + np.bincount(sentence, model.weights[what], len(heads))
    return z, heads, document_scores(z, got.row[heads], rows, model.background)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of all documents, and where the worst sentence lies.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null and
    empty texts, and texts without words, score 0. Offsets are bytes of the UTF-8
    text; ``offending`` lists every sentence that scores 0.5 or more. One row per
    row, without a shuffle.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got, offs = bag(b.column("text"))
            z, heads, total = sentence_scores(got, shared.value, b.num_rows)
            tails = np.r_[heads[1:], len(got.sentence)] - 1
            row = got.row[heads]
            n = b.num_rows
            found: list[list] = [[] for _ in range(n)]
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            for i in np.flatnonzero(p >= 0.5):
                at = offs[row[i]]
                found[row[i]].append({"start": int(got.start[heads[i]] - at), "end": int(got.end[tails[i]] - at), "score": float(p[i])})
            cols = [pa.array(total, pa.float64()), pa.array((total >= 0.5).astype(np.int32)), pa.array(found, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "score", "predicted", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, offending array<struct<start:long,end:long,score:double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic, with all columns.

    Null and empty texts score 0 and stay; repeated rows are judged alike; an
    empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got, _ = bag(b.column("text"))
            total = sentence_scores(got, shared.value, b.num_rows)[2]
            yield b.filter(pa.array(total < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")
