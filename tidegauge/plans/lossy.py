"""Lossy transforms, size estimates, ratio prediction and quality of answers."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import bitstream, predict, profile, shape, transforms
from ..functions.domain import mantissa_truncated
from ..ml import bayes, models
from ..operators import aggregate, window
from ..streaming.pipeline import compress
from .registry import points, query, r6, vectors

P = "(SELECT event_id AS idx, user_id AS signal_id, event_type AS kind, value FROM events) p"


def _segments(spark, d, size=50):
    return window.segmentize(points(spark, d), size, flush_tail=True)


def _rebuilt(spark, d, codec):
    out = transforms.reconstruct(_segments(spark, d).select("signal_id", "seg_id", "data"), codec)
    return out.select("signal_id", "seg_id", "n_bytes", F.transform("data", lambda x: F.round(x, 6) + F.lit(0.0)).alias("data"))


SEG = f"WITH n AS (SELECT *, (row_number() OVER (PARTITION BY signal_id ORDER BY idx) - 1) // 50 AS seg_id FROM {P})"
ROWS = f"{SEG}, r AS (SELECT signal_id, seg_id, value, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY signal_id, seg_id) AS n FROM n WINDOW w AS (PARTITION BY signal_id, seg_id ORDER BY idx))"


# each gives e: signal_id, seg_id, k, value, n, est, n_bytes
def _fourier_sql(kept: str) -> str:
    turn = "2 * pi() * f * k / {}n"
    return (
        f"{ROWS}, s AS (SELECT *, CAST(floor({kept}) AS BIGINT) AS kept FROM r), c AS (SELECT signal_id, seg_id, f, sum(value * cos({turn.format('')})) AS re, sum(value * sin({turn.format('')})) AS im FROM (SELECT *, unnest(range(kept)) AS f FROM s) GROUP BY 1, 2, 3), "
        f"e AS (SELECT s.signal_id, s.seg_id, s.k, any_value(s.value) AS value, any_value(s.n) AS n, any_value(16 * s.kept) AS n_bytes, coalesce(sum((CASE WHEN f = 0 THEN 1 ELSE 2 END) * (re * cos({turn.format('s.')}) + im * sin({turn.format('s.')})) / s.n), 0) AS est FROM s LEFT JOIN c USING (signal_id, seg_id) GROUP BY 1, 2, 3)"
    )


def _linear_sql(budget: str) -> str:
    area = "abs((a - (e1 + e2 - 1) / 2.0::DOUBLE) * (y[i + 1] - y[a + 1]) - (a - i) * (my - y[a + 1]))"
    edge = "CASE WHEN {0} = b - 2 THEN n - 1 WHEN {0} = b - 1 THEN n ELSE CAST(floor({0} * ((n - 2) / (b - 2.0::DOUBLE))) AS BIGINT) + 1 END"
    return (
        f"{ROWS.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT signal_id, seg_id, list(value ORDER BY k) AS y, max(n) AS n, greatest({budget}) AS b FROM r GROUP BY 1, 2), "
        f"g AS (SELECT *, list_transform(range(b), lambda j: {edge.format('j')}) AS edge FROM s WHERE n >= 3 AND b >= 3 AND b < n), "
        "q AS (SELECT signal_id, seg_id, CAST(0 AS BIGINT) AS bucket, [CAST(0 AS BIGINT)] AS kept FROM g UNION ALL "
        f"SELECT signal_id, seg_id, bucket + 1, list_append(kept, e0 + list_position(areas, list_max(areas)) - 1) FROM (SELECT *, list_transform(range(e0, e1), lambda i: {area}) AS areas FROM "
        "(SELECT q.*, g.y, g.edge[q.bucket + 1] AS e0, g.edge[q.bucket + 2] AS e1, g.edge[q.bucket + 3] AS e2, q.kept[-1] AS a, list_avg(g.y[g.edge[q.bucket + 2] + 1 : g.edge[q.bucket + 3]]) AS my FROM q JOIN g USING (signal_id, seg_id) WHERE q.bucket < g.b - 2))), "
        "points AS (SELECT signal_id, seg_id, list_append(q.kept, n - 1) AS kept FROM q JOIN g USING (signal_id, seg_id) WHERE q.bucket = g.b - 2 UNION ALL SELECT signal_id, seg_id, CASE WHEN n < 3 OR b >= n THEN range(n) ELSE [0, n - 1] END FROM s WHERE n < 3 OR b < 3 OR b >= n), "
        "lines AS (SELECT signal_id, seg_id, kept[j] AS x0, kept[j + 1] AS x1 FROM (SELECT *, unnest(range(1, len(kept) + 1)) AS j FROM points)), "
        "e AS (SELECT r.signal_id, r.seg_id, r.k, r.value, s.n, 16 * least(s.n, s.b) AS n_bytes, CASE WHEN x1 IS NULL THEN y[x0 + 1] ELSE y[x0 + 1] + (y[x1 + 1] - y[x0 + 1]) / (x1 - x0) * (k - x0) END AS est FROM r JOIN s USING (signal_id, seg_id) JOIN lines l ON l.signal_id = r.signal_id AND l.seg_id = r.seg_id AND k >= x0 AND (k < x1 OR x1 IS NULL))"
    )


REBUILT = " SELECT signal_id, seg_id, CAST(any_value(n_bytes) AS BIGINT) AS n_bytes, list(round(est, 6) + 0.0::DOUBLE ORDER BY k) AS data FROM e GROUP BY 1, 2"
MEANS = f"{ROWS}, e AS (SELECT *, avg(value) OVER (PARTITION BY signal_id, seg_id, k // 4) AS est, 8 * ((n + 3) // 4) AS n_bytes FROM r)"


@query("fourier_reconstruct", _fourier_sql("n * 0.25 / 2") + REBUILT)
def fourier_reconstruct(spark, d):
    return _rebuilt(spark, d, transforms.Fourier(0.25))


@query("leading_fourier", _fourier_sql("n * 0.25") + REBUILT)
def leading_fourier(spark, d):
    return _rebuilt(spark, d, transforms.LeadingFourier(0.25))


@query("pla_reconstruct", _linear_sql("4, CAST(floor(0.25 * max(n)) AS BIGINT)") + REBUILT)
def pla_reconstruct(spark, d):
    return _rebuilt(spark, d, transforms.Pla(0.5))


@query("pla_ratio", _linear_sql("2, CAST(floor(0.25 * max(n)) AS BIGINT)") + REBUILT)
def pla_ratio(spark, d):
    return _rebuilt(spark, d, transforms.Pla(0.25, whole_ratio=True))


@query("rrd_reconstruct", f"{SEG} SELECT signal_id, seg_id, 8::BIGINT AS n_bytes, list_transform(list(value ORDER BY idx), lambda x: round(arg_min(value, idx), 6)) AS data FROM n GROUP BY 1, 2".replace("round(arg_min(value, idx), 6)", "round(fv, 6)").replace("FROM n GROUP BY 1, 2", "FROM (SELECT *, first_value(value) OVER (PARTITION BY signal_id, seg_id ORDER BY idx) AS fv FROM n) GROUP BY 1, 2, fv"))
def rrd_reconstruct(spark, d):
    return _rebuilt(spark, d, transforms.FirstValue())


@query(
    "bufflossy",
    f"{SEG}, c AS (SELECT *, CAST(floor(value * 256) AS BIGINT) AS code FROM n), b AS (SELECT *, min(code) OVER w AS lo, greatest(0, CASE WHEN max(code) OVER w = min(code) OVER w THEN 0 ELSE CAST(floor(log2(max(code) OVER w - min(code) OVER w)) AS INTEGER) + 1 END - 8) AS dr FROM c WINDOW w AS (PARTITION BY signal_id, seg_id)) SELECT signal_id, seg_id, list(round((((code - lo) >> dr << dr) + lo) / 256, 6) ORDER BY idx) AS data FROM b GROUP BY 1, 2",
)
def bufflossy(spark, d):
    return _rebuilt(spark, d, transforms.TruncatedFixed(100, 8)).drop("n_bytes")


@query("paa_segments", f"{SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY signal_id, seg_id ORDER BY idx) - 1 AS k FROM n), a AS (SELECT *, avg(value) OVER (PARTITION BY signal_id, seg_id, k // 8) AS m FROM r) SELECT signal_id, seg_id, list(round(m, 6) ORDER BY idx) AS data FROM a GROUP BY 1, 2")
def paa_segments(spark, d):
    return _rebuilt(spark, d, transforms.Paa(8)).drop("n_bytes")


@query("mantissa_truncation")
def mantissa_truncation(spark, d):
    return mantissa_truncated(points(spark, d).select("idx", "signal_id", "value"), "value", "idx", ["signal_id"], 2)


@query("landmark_features")
def landmark_features(spark, d):
    v = vectors(spark, d)
    marks = np.array([r.vector for r in v.filter("id < 8").orderBy("id").collect()], float)
    return shape.Landmarks(marks).transform(v.select("id", F.col("vector").cast("array<double>").alias("vector")), "vector").select("id", "features")


CROSS = "list_max(list_transform(range(-63, 64), lambda s: list_sum(list_transform(range(greatest(1, 1 - s), least(64, 64 - s) + 1), lambda i: x[i + s] * y[i]))))"
NORM = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"


@query("shape_distance", f"SELECT id, list(round(1 - {CROSS} / ({NORM.format('x')} * {NORM.format('y')}), 6) ORDER BY m) AS distances FROM (SELECT a.vec_id AS id, b.vec_id AS m, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id < 4) GROUP BY 1")
def shape_distance(spark, d):
    def series(v):
        """Without its nulls; where there is nothing else there is no distance."""
        missing = [z is None for z in v or ()]
        if all(missing):
            return None
        x = np.array(v, float)
        return np.ma.masked_array(x, missing) if any(missing) else x

    v = vectors(spark, d).select("id", F.col("vector").cast("array<double>").alias("vector"))
    marks = [series(r.vector) for r in v.filter("id < 4").orderBy("id").collect()]

    def run(batches):
        for b in batches:
            rows = map(series, b.column("vector").to_pylist())
            out = [[None if x is None or m is None else shape.half_away(shape.embedding_distance(x, m), 6) for m in marks] for x in rows]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.float64()))], names=["id", "distances"])

    kind = v.schema["id"].dataType.simpleString()
    return v.filter(F.lit(bool(marks))).mapInArrow(run, f"id {kind}, distances array<double>")


# ----------------------------------------------------------- sizes and prediction
def _widths(x):
    return f"CASE WHEN {x} = 0 THEN 0 ELSE floor(log2({x})) + 1 END"


def _tenth(spark, d):
    """The first 10 % of the positions."""
    p = points(spark, d)
    return predict.prefix(p, p.count() // 10)


@query("ratio_buff", f"SELECT ({_widths('s')} + 8) / 64.0::DOUBLE AS ratio FROM (SELECT floor(max(value) - min(value)) AS s FROM {P} WHERE idx < (SELECT count(*) // 10 FROM events))")
def ratio_buff(spark, d):
    return predict.buff_ratio(_tenth(spark, d), 2)


@query("ratio_dictionary", f"SELECT ({_widths('k')} * n + k * 64) / (64.0::DOUBLE * n) AS ratio FROM (SELECT count(DISTINCT value) AS k, count(*) AS n FROM {P} WHERE idx < (SELECT count(*) // 10 FROM events))")
def ratio_dictionary(spark, d):
    return predict.dictionary_ratio(_tenth(spark, d))


@query("ratio_sprintz", f"WITH c AS (SELECT idx, CAST(trunc(value * CAST(100 AS DOUBLE)) AS BIGINT) AS code FROM {P} WHERE idx < (SELECT count(*) // 10 FROM events)), z AS (SELECT code - coalesce(lag(code) OVER (ORDER BY idx), 0) AS dl FROM c), m AS (SELECT max(CASE WHEN dl <= 0 THEN -2 * dl ELSE 2 * dl - 1 END) AS z FROM z) SELECT ({_widths('z')}) / 64.0::DOUBLE AS ratio FROM m")
def ratio_sprintz(spark, d):
    return predict.sprintz_ratio(_tenth(spark, d), 2)


@query("ratio_measured")
def ratio_measured(spark, d):
    sample = _tenth(spark, d).cache()
    return spark.createDataFrame([(n, predict.measured_ratio(sample, n, 100)) for n in ("buff", "sprintz", "snappy", "gorilla", "gzip", "zlib9")], "method string, ratio double")


BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


@query(
    "packed_sizes",
    f"{SEG}, c AS (SELECT signal_id, seg_id, idx, CAST(sign(value) * floor(abs(value) * 256) AS BIGINT) AS fx, CAST(ceil(value * 100.0::DOUBLE) AS BIGINT) AS dec FROM n), z AS (SELECT *, dec - lag(dec) OVER (PARTITION BY signal_id, seg_id ORDER BY idx) AS dl FROM c), s AS (SELECT count(*) AS n, max(fx) - min(fx) AS w, coalesce(max(CASE WHEN dl < 0 THEN -2 * dl - 1 ELSE 2 * dl END), 0) AS zz FROM z GROUP BY signal_id, seg_id), b AS (SELECT 'buff' AS method, n, 20 + n * ((({BITS.format('w')}) + 7) // 8) AS bytes FROM s UNION ALL SELECT 'sprintz', n, (72 + n * ({BITS.format('zz')}) + 7) // 8 FROM s) SELECT method, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / (8.0::DOUBLE * sum(n)), 6) AS ratio FROM b GROUP BY 1",
)
def packed_sizes(spark, d):
    segments = _segments(spark, d).select("signal_id", "seg_id", "size", "data")
    out = compress(segments, "buff", 100).union(compress(segments, "sprintz", 100))
    return out.groupBy("method").agg(F.sum("n_bytes").alias("bytes"), r6(F.sum("n_bytes") / (8.0 * F.sum("size"))).alias("ratio"))


STREAMS = ("gorilla", "bp", "deltabp", "snappy", "gzip", "zlib", "deflate")


@query("bitstream_round_trip", f"{SEG}, b AS (SELECT signal_id, seg_id, list(value ORDER BY idx) AS raw, list(ceil(value * 100.0::DOUBLE) / 100 ORDER BY idx) AS code FROM n GROUP BY 1, 2) SELECT method, signal_id, seg_id, CASE WHEN method IN ('bp', 'deltabp') THEN code ELSE raw END AS data FROM b, (SELECT unnest({list(STREAMS)}) AS method)")
def bitstream_round_trip(spark, d):
    """Each method's bytes, decoded again."""
    segments = _segments(spark, d).select("signal_id", "seg_id", "data")
    parts = [transforms.per_series(partial(bitstream.round_trip, name=n, scale=100), segments, "data").select(F.lit(n).alias("method"), "signal_id", "seg_id", "data") for n in STREAMS]
    return reduce(DataFrame.union, parts)


@query("compressed_sizes")
def compressed_sizes(spark, d):
    segments = _segments(spark, d).select("signal_id", "seg_id", "size", "data")
    parts = [compress(segments, n, 100) for n in ("buff", "sprintz", "gorilla", "snappy", "gzip", "zlib1")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("method").agg(F.sum("n_bytes").alias("bytes"), r6(F.sum("n_bytes") / (8.0 * F.sum("size"))).alias("ratio"))


# -------------------------------------------------------------- quality of answers
EST = f"(SELECT idx, idx // 100 AS node, value, avg(value) OVER (PARTITION BY idx // 7) AS est FROM {P})"
QUAL = f"s AS (SELECT node, max(value) AS mx, min(value) AS mn, sum(value) AS sm, max(est) AS emx, min(est) AS emn, sum(est) AS esm FROM {EST} GROUP BY 1), e AS (SELECT min(node) AS lo, max(node) AS hi FROM s)"


def _stats(spark, d):
    p = points(spark, d)
    est = window.reconstruct_means(p, 7)
    return tuple(aggregate.segment_stats(x, 100) for x in (p, est))


@query(
    "quality_windows",
    f"WITH {QUAL}, w AS (SELECT unnest(['all'] || CASE WHEN node < lo + 10 THEN ['first'] ELSE [] END || CASE WHEN node > hi - 10 THEN ['last'] ELSE [] END) AS scope, s.* FROM s, e) SELECT scope, round(abs(max(mx) - max(emx)) / abs(max(mx)), 6) AS max_error, round(abs(min(mn) - min(emn)) / abs(min(mn)), 6) AS min_error, round(abs(sum(sm) - sum(esm)) / abs(sum(sm)), 6) AS sum_error FROM w GROUP BY 1",
)
def quality_windows(spark, d):
    out = aggregate.quality_windows(*_stats(spark, d))
    return out.select("scope", *[r6(c).alias(c) for c in out.columns[1:]])


@query("mean_errors", f"WITH {QUAL} SELECT round(avg(abs(mx - emx) / abs(mx)), 6) AS max_error, round(avg(abs(sm - esm) / abs(sm)), 6) AS sum_error FROM s, e WHERE node <= hi - 10")
def mean_errors(spark, d):
    out = aggregate.mean_errors(*_stats(spark, d))
    return out.select([r6(c).alias(c) for c in out.columns])


LIKELY = "SELECT e.idx, e.kind, k.c, ln(k.n * 1.0::DOUBLE / (SELECT sum(n) FROM k)) - (e.v - k.m1) ** 2 / (2 * k.v1) - ln(k.v1) / 2 - (e.signal_id - k.m2) ** 2 / (2 * k.v2) - ln(k.v2) / 2 AS s FROM {} e, k"
PICK = "SELECT idx, kind, c FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s DESC, c) AS r FROM ({})) WHERE r = 1"


@query(
    "lossy_model_agreement",
    f"WITH k AS (SELECT kind AS c, count(*) AS n, avg(value) AS m1, var_pop(value) AS v1, avg(signal_id) AS m2, var_pop(signal_id) AS v2 FROM {P} GROUP BY 1), x AS (SELECT *, value AS v FROM {P}), y AS (SELECT *, avg(value) OVER (PARTITION BY idx // 4) AS v FROM {P}), a AS ({PICK.format(LIKELY.format('x'))}), b AS ({PICK.format(LIKELY.format('y'))}) SELECT round(avg(CASE WHEN a.c = a.kind THEN 1.0 ELSE 0.0 END), 6) AS exact_accuracy, round(avg(CASE WHEN b.c = a.kind THEN 1.0 ELSE 0.0 END), 6) AS lossy_accuracy, round(avg(CASE WHEN a.c = b.c THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM a JOIN b USING (idx)",
)
def lossy_model_agreement(spark, d):
    p = points(spark, d).select("idx", "kind", "value", "signal_id")
    model = bayes.gaussian(p, "kind", ["value", "signal_id"])
    out = models.lossy_agreement(p, window.reconstruct_means(p, 4), "idx", "kind", model.predict)
    return out.select([r6(c).alias(c) for c in out.columns])


def _answers_sql(method: str, decoded: str, code: str) -> str:
    pred = code.replace("value", "CAST(50.1 AS DOUBLE)")
    return (
        f"SELECT '{method}' AS method, count(*) AS n, round(sum({decoded}), 6) AS sum, max({decoded}) AS max, "
        f"(SELECT count(*) FROM events WHERE {decoded} = (SELECT max({decoded}) FROM events)) AS max_rows, "
        f"count(*) FILTER ({code} > {pred}) AS above, count(*) FILTER ({code} = {pred}) AS equal FROM events"
    )


DOMAINS = {"gorilla": ("value", "value"), "buff": ("floor(value * 256) / 256", "floor(value * 256)"), "sprintz": ("ceil(value * 100.0::DOUBLE) / 100", "ceil(value * 100.0::DOUBLE)")}


@query("codec_answers", " UNION ALL ".join(_answers_sql(n, *x) for n, x in DOMAINS.items()))
def codec_answers(spark, d):
    p = points(spark, d)
    parts = [profile.answers(p, profile.domain_of(n, 100), 50.1).select(F.lit(n).alias("method"), "n", r6("sum").alias("sum"), "max", "max_rows", "above", "equal") for n in DOMAINS]
    return parts[0].union(parts[1]).union(parts[2])


@query("codec_profile")
def codec_profile(spark, d):
    return profile.profile(points(spark, d), ["buff", "sprintz", "gorilla", "snappy", "dict", "deltabp", "dfcm"], 100, 50.1, 2000)


def _profile_sql(name: str, est: str) -> str:
    return f"(SELECT '{name}' AS method, * FROM ({est} SELECT round(sum(n_bytes / (n * 1.0::DOUBLE)) / (8 * count(*)), 6) AS ratio, round(avg(abs(value - est)), 6) AS error FROM e))"


@query("lossy_profile", " UNION ALL ".join([_profile_sql("paa", MEANS), _profile_sql("fourier", _fourier_sql("n * 0.25 / 2")), _profile_sql("leading", _fourier_sql("n * 0.125")), _profile_sql("pla", _linear_sql("4, CAST(floor(0.125 * max(n)) AS BIGINT)"))]))
def lossy_profile(spark, d):
    out = profile.lossy_profile(_segments(spark, d).select("signal_id", "seg_id", "data"), profile.default_lossy())
    return out.select("method", r6("ratio").alias("ratio"), r6("error").alias("error"))
