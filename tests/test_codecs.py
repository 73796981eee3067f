"""Invariants of domains, transforms and size models."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.codecs import bitstream, shape, size, transforms
from tidegauge.functions import domain
from tidegauge.operators import similarity, window

floats = st.lists(st.floats(-1000, 1000, allow_nan=False).map(lambda v: round(v, 2)), min_size=1, max_size=60)


def test_fixed_is_bounded_and_idempotent(spark):
    df = spark.range(2000).select((F.rand(1) * 200 - 100).alias("x"))
    for p in range(1, 9):
        f = domain.Fixed.of(p)
        once = f.decode(F.col("x"))
        worst, again = df.select(once.alias("y"), "x").agg(F.max(F.abs(F.col("x") - F.col("y"))), F.max(F.abs(F.col("y") - f.decode(F.col("y"))))).first()
        assert worst < 10**-p
        assert again == 0


def test_precision_is_checked():
    assert domain.precision_bound(4) == 0.000049
    for p in (0, 12):
        with pytest.raises(ValueError, match="precision"):
            domain.fraction_bits(p)
    with pytest.raises(ValueError, match="scale"):
        domain.precision_of(7)


@settings(deadline=None, max_examples=40)
@given(floats, st.integers(1, 6))
def test_mantissa_truncation_is_bounded(values, p):
    x = np.array(values)
    assert np.all(np.abs(domain.truncate_mantissa(x, p) - x) <= np.maximum(domain.precision_bound(p), 1e-300))


@settings(deadline=None, max_examples=60)
@given(floats)
def test_identities(values):
    x = np.array(values)
    assert np.allclose(transforms.Paa(1).decode(x), x)
    assert np.allclose(transforms.LeadingFourier(1.0).decode(x)[: len(x)], transforms.LeadingFourier(1.0).decode(x))
    assert np.allclose(transforms.Fourier(2.0).decode(x), x)
    assert np.allclose(transforms.Pla(1.0, whole_ratio=True).decode(x), x)
    assert np.allclose(transforms.FirstValue().decode(x), x[0])
    assert np.abs(transforms.TruncatedFixed(100, 64).decode(x) - x).max() <= 1 / 256
    for codec in (transforms.Paa(3), transforms.Fourier(0.5), transforms.Pla(0.5), transforms.TruncatedFixed(100, 16)):
        assert len(codec.decode(x)) == len(x)


def test_short_last_chunk():
    x = np.array([1.0, 3, 5])
    assert list(transforms.piecewise_means(x, 2)) == [2, 5]
    assert list(transforms.piecewise_means(x, 2, full_divisor=True)) == [2, 2.5]


def test_triangles_keep_ends_and_peaks():
    y = np.zeros(100)
    y[37] = 10
    at = transforms.largest_triangles(y, 10)
    assert at[0] == 0 and at[-1] == 99 and len(at) == 10 and 37 in at


def test_halving():
    assert transforms.halved(transforms.Paa(4)).window == 8
    assert transforms.halved(transforms.Paa(5000)).window == 5000
    assert transforms.halved(transforms.Fourier(0.5)).ratio == 0.25
    assert transforms.halved(transforms.Pla(0.5)).ratio == 0.25
    assert transforms.halved(transforms.TruncatedFixed(100, 24)).bits == 16
    assert transforms.for_ratio("paa", 0.3).window == 4
    assert transforms.for_ratio("bufflossy", 0.3, 100).bits == 16


@settings(deadline=None, max_examples=40)
@given(floats)
def test_segment_bytes(values):
    x = np.array(values)
    assert np.array_equal(size.segment_values(size.segment_bytes(x)), x)
    for f in size.LOSSLESS.values():
        assert f(x, 100) > 0


def test_repeats_are_small():
    x = np.full(1000, 3.25)
    assert size.gorilla(x) < 200
    assert size.bit_packed(np.full(1000, 7)) == 9
    assert size.byte_codec(x, "deflate") < 100


def test_shift_invariance():
    x = np.sin(np.arange(64) / 5.0) * np.hanning(64)
    assert shape.sink(x, x, 5.0) == pytest.approx(1)
    assert shape.embedding_distance(x, np.r_[np.zeros(5), x[:-5]]) < 0.05
    marks = shape.Landmarks(np.stack([x, x[::-1], np.cos(np.arange(64))]))
    f = np.array([marks.features(r) for r in marks.rows])
    assert np.allclose(f @ f.T, [[shape.sink(a, b, 5.0) for b in marks.rows] for a in marks.rows], atol=1e-6)


def test_skewed_segmentation_agrees(spark):
    from tidegauge.operators.window import segmentize

    points = spark.range(500).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 10).cast("long").alias("signal_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("value"),
    )
    for tail in (False, True):
        a, b = ({(r.signal_id, r.seg_id): r.data for r in segmentize(points, 7, flush_tail=tail, skewed=s).collect()} for s in (False, True))
        assert a == b and a


def test_positions_and_totals(spark):
    from tidegauge.operators.ranges import numbered, running_total

    df = spark.range(300).select(((F.col("id") * 37) % 300).alias("k"), F.lit(2).alias("v"))
    assert all(r.k == r.at for r in numbered(df, ["k"], "at").collect())
    assert all(r.before == 2 * (299 - r.k) for r in running_total(df, F.desc("k"), "v", "before").collect())


@settings(deadline=None, max_examples=80)
@given(st.lists(st.one_of(st.floats(allow_nan=False, allow_infinity=False), st.sampled_from([0.0, 1.0, 1.5, -2.0])), max_size=40))
def test_streams_round_trip(values):
    x = np.array(values)
    raw = bitstream.xor_encode(x)
    assert np.array_equal(bitstream.xor_decode(raw), x)
    assert len(raw) - 4 == size.gorilla(x)
    for name in ("snappy", "gzip", "zlib", "deflate"):
        assert np.array_equal(bitstream.byte_round_trip(x, name), x)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(-(2**40), 2**40), max_size=40))
def test_packed_codes_round_trip(values):
    c = np.array(values, np.int64)
    assert np.array_equal(bitstream.frame_decode(bitstream.frame_encode(c), len(c)), c)
    assert np.array_equal(bitstream.delta_decode(bitstream.delta_encode(c), len(c)), c)
    assert len(bitstream.frame_encode(c)) == size.bit_packed(c)
    assert len(bitstream.delta_encode(c)) == size.delta_packed(c)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_zero_bits(words):
    lead, trail = window.zero_bits(np.array(words, np.uint64))
    assert lead.tolist() == [64 - w.bit_length() for w in words]
    assert trail.tolist() == [(w & -w).bit_length() - 1 if w else 64 for w in words]


def test_mantissas_go_on_across_batches(spark):
    """Small Arrow batches cut a series like one array."""
    r = np.random.default_rng(4)
    rows = [(i, i % 3, float(v)) for i, v in enumerate(r.uniform(-50, 50, 900))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {x.idx: x.value for x in domain.mantissa_truncated(spark.createDataFrame(rows, "idx long, signal_id long, value double").repartition(4), "value", "idx", ["signal_id"], 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(3):
        part = [(i, v) for i, k, v in rows if k == s]
        assert [got[i] for i, _ in part] == domain.truncate_mantissa(np.array([v for _, v in part]), 2).tolist()


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(1, 4), st.integers(0, 1000))
def test_near_pairs_are_exact(n, m, k, seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(-3, 4, (n, 5)) * 1e3 + r.normal(size=(n, 5)), r.integers(-3, 4, (m, 5)) * 1e3 + r.normal(size=(m, 5))
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    top = min(k, m)
    i, j, got = similarity.near(x, y, lambda rough: np.partition(rough, top - 1, axis=1)[:, top - 1 : top])
    assert np.allclose(got, d[i, j], rtol=1e-12)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert all((a, int(b)) in pairs for a in range(n) for b in np.argsort(d[a], kind="stable")[:top])
