"""The toxicity model against plain versions, and its sample."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from conftest import DATA
from test_operators import ROWS, prose
from test_operators import docs as docs  # noqa: F401  the fixture

from tidegauge.llm import toxicity
from tidegauge.llm._shared import span_hashes, table
from tidegauge.llm._shared import mix64


def key(word: bytes, prefix: int = 0) -> int:
    one = lambda w: span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    with np.errstate(over="ignore"):
        return int(mix64(one(word[:prefix]) + np.uint64(prefix))[0]) if prefix else int(one(word)[0])


def plain_score(text: str, model: toxicity.Model) -> float:
    """Sentence by sentence, word by word."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    strong, weak = 0.0, 0.0
    for sentence in re.split(rb"[.!?\n]", low):
        words = re.findall(rb"[a-z\x80-\xff]+", sentence)
        if not words:
            continue
        found = {key(w) for w in words} | {key(w, n) for w in words for n in toxicity.PREFIXES if len(w) > n}
        z = model.bias + sum(weight.get(f, 0.0) for f in found)
        e = math.log1p(math.exp(z)) if z < 30 else z
        if z >= 0:
            strong += e
        else:
            weak += e - model.background
    return 1 - math.exp(-strong - max(weak, 0.0))


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (table(spark, DATA, n) for n in ("documents", "labels"))
    return docs, labels, toxicity.train(docs, labels)


def test_scores_equal_a_plain_version(spark, trained, docs):  # noqa: F811
    whole, _, model = trained
    rows = [(r.doc_id, r.text) for r in whole.collect()[:300]]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(whole, model).collect()}
    for d, t in rows:
        want = plain_score(t, model)
        assert got[d][0] == pytest.approx(want, abs=1e-9)
        assert got[d][1] == int(want >= 0.5)
    small = sorted(round(r.score, 9) for r in toxicity.score(docs, model).collect())
    assert small == pytest.approx(sorted(plain_score(t, model) for _, t in ROWS), abs=1e-6)


def test_labels_of_other_tables_leave_the_model_unchanged(spark, trained):
    docs, labels, model = trained
    foreign = spark.range(10_000_000, 10_100_000).selectExpr("id AS doc_id", "0 AS quality", "CAST(id % 2 AS INT) AS toxic")
    other = toxicity.train(docs, labels.select("doc_id", "quality", labels.toxic.cast("int").alias("toxic")).union(foreign))
    assert np.array_equal(other.features, model.features) and np.allclose(other.weights, model.weights) and other.bias == pytest.approx(model.bias)
    assert len(model.features)


def test_repeated_ids_are_bounded(spark, monkeypatch):
    """An id with many texts is many rows: at most ``rows`` of them are drawn."""
    rows = [(1, prose(i, 12) + (" vile" if i % 2 else "")) for i in range(300)] + [(i, prose(i, 12) + (" vile" if i % 2 else "")) for i in range(2, 60)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, toxic int")
    a, b = toxicity.train(df, labels, rows=40), toxicity.train(df.repartition(7), labels, rows=40)
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_fit_equals_a_dense_fit():
    """The same steps on a dense table of sentences and features."""
    r = np.random.default_rng(3)
    docs, feats = 60, 8
    per = r.integers(1, 6, docs)
    row = np.repeat(np.arange(docs), per)
    x = (r.random((len(row), feats)) < 0.3).astype(float)
    x[:, 0] = (r.random(len(row)) < 0.15) | (x[:, 0] * (row % 3 == 0) > 0)
    y = np.array([int(x[row == d, 0].any()) for d in range(docs)])
    assert 0 < y.mean() < 1

    w, b = np.zeros(feats), -5.0
    m, v = np.zeros(feats + 1), np.zeros(feats + 1)
    for t in range(1, toxicity.ROUNDS + 1):
        z = x @ w + b
        p = 1 / (1 + np.exp(-z))
        miss = np.array([np.prod(1 - p[row == d]) for d in range(docs)])
        doc = np.clip(1 - miss, 1e-9, 1 - 1e-9)
        # the loss's slope along each sentence's logit
        slope = np.where(y[row] == 1, -(1 - doc[row]) / doc[row], 1.0) * p
        g = np.r_[x.T @ slope + 0.02 * w, slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], min(b - step[-1], -2.0)

    has = x.any(axis=1)
    bare = np.bincount(row[~has], minlength=docs)
    s, f = np.nonzero(x[has])
    model = toxicity.fit(np.arange(feats, dtype=np.uint64), (s, f), row[has], bare, y)
    dense = {i: c for i, c in enumerate(w) if abs(c) > 1e-3}
    assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(dense, abs=1e-5)
    assert model.bias == pytest.approx(b, abs=1e-5)
