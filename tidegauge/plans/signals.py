"""Filters, projections, aggregates, windows and joins over the events signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.domain import Ceil, Fixed, Raw, signed_code, unsigned_code
from ..functions.scalar import bit_width, bits_to_int, second_wins_max, second_wins_min, split_bits, unzigzag, zigzag
from ..operators import aggregate, filters, joins, sets, stats_index, topk, window
from .registry import points, query, r6

P = "(SELECT event_id AS idx, user_id AS signal_id, ts, event_type AS kind, value FROM events) p"
FIX = "sign({0}) * floor(abs({0}) * 256) / 256"


# ------------------------------------------------------- joins and latest rows
@query("low_last_value", f"SELECT signal_id, max(idx) AS idx, arg_max(value, idx) AS value FROM {P} GROUP BY signal_id HAVING arg_max(value, idx) < 5")
def low_last_value(spark, d):
    return joins.latest_per_key(points(spark, d).select("signal_id", "idx", "value")).filter("value < 5").select("signal_id", "idx", "value")


@query("last_per_key", f"SELECT signal_id, max(idx) AS idx, arg_max(value, idx) AS value FROM {P} WHERE signal_id IN (SELECT user_id FROM events WHERE user_id < 50) GROUP BY signal_id")
def last_per_key(spark, d):
    p = points(spark, d).select("signal_id", "idx", "value")
    return joins.latest_per_key(p, p.filter("signal_id < 50"))


@query("count_last_gt", f"SELECT count(*) AS n FROM (SELECT arg_max(value, idx) AS v FROM {P} GROUP BY signal_id) WHERE v > 20")
def count_last_gt(spark, d):
    return joins.latest_per_key(points(spark, d).select("signal_id", "idx", "value")).filter("value > 20").agg(F.count("*").alias("n"))


@query("key_semi_join", f"SELECT idx, signal_id, value FROM {P} WHERE signal_id IN (SELECT user_id FROM events WHERE value > 300)")
def key_semi_join(spark, d):
    p = points(spark, d).select("idx", "signal_id", "value")
    return filters.keyed(p, p.filter("value > 300"), "signal_id").select("idx", "signal_id", "value")


@query("positional_join", f"SELECT idx, signal_id, value, value * 2 AS doubled FROM {P}")
def positional_join(spark, d):
    p = points(spark, d)
    return joins.positional(p.select("idx", "signal_id"), p.select("idx", "value"), p.select("idx", (F.col("value") * 2).alias("doubled")))


@query("key_range_filter", f"SELECT count(*) AS n FROM {P} WHERE signal_id < 100 AND value > 20")
def key_range_filter(spark, d):
    return filters.range_filter(points(spark, d).filter("signal_id < 100"), 20).agg(F.count("*").alias("n"))


@query("key_in_list", f"SELECT idx, signal_id FROM {P} WHERE signal_id IN (3, 5, 8, 13)")
def key_in_list(spark, d):
    return filters.key_in(points(spark, d), "signal_id", [3, 5, 8, 13]).select("idx", "signal_id")


@query("point_lookup", f"SELECT idx, signal_id, value FROM {P} WHERE idx = 777")
def point_lookup(spark, d):
    return points(spark, d).filter("idx = 777").select("idx", "signal_id", "value")


# ------------------------------------------------------ filters and projections
@query("range_filter_raw", f"SELECT idx, value FROM {P} WHERE value > 50")
def range_filter_raw(spark, d):
    return filters.range_filter(points(spark, d), 50, Raw()).select("idx", "value")


@query("equal_filter_raw", f"SELECT idx, value FROM {P} WHERE value = 21.51")
def equal_filter_raw(spark, d):
    return filters.equal_filter(points(spark, d), 21.51).select("idx", "value")


@query("range_filter_fixed", f"SELECT idx, value FROM {P} WHERE floor(value * 256) > floor(CAST(50.1 AS DOUBLE) * 256)")
def range_filter_fixed(spark, d):
    return filters.range_filter(points(spark, d), 50.1, Fixed.of(2)).select("idx", "value")


@query("equal_filter_fixed", f"SELECT idx, value FROM {P} WHERE floor(value * 256) = floor(CAST(21.51 AS DOUBLE) * 256)")
def equal_filter_fixed(spark, d):
    return filters.equal_filter(points(spark, d), 21.51, Fixed.of(2)).select("idx", "value")


@query("range_filter_ceil", f"SELECT idx, value FROM {P} WHERE ceil(value * CAST(100 AS DOUBLE)) > ceil(CAST(50.1 AS DOUBLE) * 100)")
def range_filter_ceil(spark, d):
    return filters.range_filter(points(spark, d), 50.1, Ceil(100)).select("idx", "value")


@query("equal_filter_ceil", f"SELECT idx, value FROM {P} WHERE ceil(value * CAST(100 AS DOUBLE)) = ceil(CAST(21.505 AS DOUBLE) * 100)")
def equal_filter_ceil(spark, d):
    return filters.equal_filter(points(spark, d), 21.505, Ceil(100)).select("idx", "value")


@query("decode_fixed", f"SELECT idx, {FIX.format('value')} AS value FROM {P}")
def decode_fixed(spark, d):
    return filters.materialize(points(spark, d), Fixed.of(2)).select("idx", "value")


@query("decode_ceil", f"SELECT idx, ceil(value * CAST(100 AS DOUBLE)) / 100 AS value FROM {P}")
def decode_ceil(spark, d):
    return filters.materialize(points(spark, d), Ceil(100)).select("idx", "value")


@query("project_positions", f"SELECT idx, value FROM {P} WHERE idx % 97 = 0")
def project_positions(spark, d):
    p = points(spark, d)
    return filters.at_positions(p, p.select("idx").filter("idx % 97 = 0")).select("idx", "value")


@query("project_precision", f"SELECT idx, floor(value * 32) / 32 AS p1, floor(value) AS p0, floor(value * 256) / 256 AS p1_bytes FROM {P}")
def project_precision(spark, d):
    v = F.col("value")
    return points(spark, d).select("idx", Fixed.partial(1, 2).decode(v).alias("p1"), Fixed.partial(0, 2).decode(v).alias("p0"), Fixed.partial(1, 2, whole_bytes=True).decode(v).alias("p1_bytes"))


@query("precision_scan", f"SELECT round(sum(floor(value * 256) / 256), 6) AS p2, round(sum(floor(value * 32) / 32), 6) AS p1, round(sum(floor(value)), 6) AS p0 FROM {P}")
def precision_scan(spark, d):
    v = F.col("value")
    return points(spark, d).agg(*[r6(F.sum(Fixed.partial(p, 2).decode(v))).alias(f"p{p}") for p in (2, 1, 0)])


@query("cond_range", f"SELECT idx, value FROM {P} WHERE idx % 7 = 0 AND value > 50")
def cond_range(spark, d):
    p = points(spark, d)
    return filters.conditional_filter(p, p.select("idx").filter("idx % 7 = 0"), ">", 50).select("idx", "value")


@query("cond_less", f"SELECT idx, value FROM {P} WHERE idx % 7 = 0 AND value < 10")
def cond_less(spark, d):
    p = points(spark, d)
    return filters.conditional_filter(p, p.select("idx").filter("idx % 7 = 0"), "<", 10).select("idx", "value")


@query("cond_less_fixed", f"SELECT idx, value FROM {P} WHERE idx % 7 = 0 AND floor(value * 256) < floor(CAST(10.3 AS DOUBLE) * 256)")
def cond_less_fixed(spark, d):
    p = points(spark, d)
    return filters.conditional_filter(p, p.select("idx").filter("idx % 7 = 0"), "<", 10.3, Fixed.of(2)).select("idx", "value")


@query("byte_filters", f"SELECT count(*) FILTER (b > 69) AS above, count(*) FILTER (b = 69) AS equal FROM (SELECT CAST(floor(value) AS BIGINT) % 256 AS b FROM {P})")
def byte_filters(spark, d):
    b = points(spark, d).select((F.floor("value") % 256).alias("b"))
    return b.agg(F.count_if(F.col("b") > 69).alias("above"), F.count_if(F.col("b") == 69).alias("equal"))


@query("binarize", f"SELECT idx, CASE WHEN value > 20 THEN 1 ELSE 0 END AS bit FROM {P}")
def binarize(spark, d):
    return points(spark, d).select("idx", filters.binarize(F.col("value"), 20).alias("bit"))


@query("integer_codes", f"SELECT idx, CAST(abs(ceil(value * CAST(10 AS DOUBLE))) AS BIGINT) AS unsigned, CAST(ceil(CAST(CAST(value AS FLOAT) AS DOUBLE) * 10) AS INTEGER) AS signed FROM {P}")
def integer_codes(spark, d):
    return points(spark, d).select("idx", unsigned_code(F.col("value"), 10.0).alias("unsigned"), signed_code(F.col("value"), 10.0).alias("signed"))


# ------------------------------------------------------------------ aggregates
STATS = "max(value) AS max, min(value) AS min, round(sum(value), 6) AS sum, count(value) AS count"


@query("agg_basic", f"SELECT {STATS}, round(avg(value), 6) AS avg FROM {P}")
def agg_basic(spark, d):
    return aggregate.summary(points(spark, d)).withColumns({"sum": r6("sum"), "avg": r6("avg")})


@query("agg_bounded", f"SELECT {STATS}, round(avg(value), 6) AS avg FROM {P} WHERE idx >= 200 AND idx < 900")
def agg_bounded(spark, d):
    return aggregate.summary(points(spark, d), time="idx", start=200, end=900).withColumns({"sum": r6("sum"), "avg": r6("avg")})


@query("integer_average", f"SELECT CAST(sum(signal_id) // count(signal_id) AS BIGINT) AS avg FROM {P}")
def integer_average(spark, d):
    return points(spark, d).agg(aggregate.integer_average(F.col("signal_id")).alias("avg"))


@query("agg_by_segment", f"SELECT idx // 1000 AS node, min(idx) AS start, max(idx) + 1 AS \"end\", {STATS} FROM {P} GROUP BY 1")
def agg_by_segment(spark, d):
    return aggregate.segment_stats(points(spark, d), 1000).withColumn("sum", r6("sum"))


@query("agg_by_signal_segment", f"SELECT signal_id, idx // 1000 AS node, min(idx) AS start, max(idx) + 1 AS \"end\", {STATS} FROM {P} GROUP BY 1, 2")
def agg_by_signal_segment(spark, d):
    return aggregate.segment_stats(points(spark, d), 1000, ["signal_id"]).withColumn("sum", r6("sum"))


@query("agg_merge", f"SELECT min(idx) AS start, max(idx) + 1 AS \"end\", {STATS}, round(avg(value), 6) AS avg FROM {P}")
def agg_merge(spark, d):
    return aggregate.merge_stats(aggregate.segment_stats(points(spark, d), 1000)).withColumns({"sum": r6("sum"), "avg": r6("avg")})


@query("argmax_positions", f"SELECT idx, value FROM {P} WHERE value = (SELECT max(value) FROM events)")
def argmax_positions(spark, d):
    return aggregate.top_rows(points(spark, d)).select("idx", "value")


@query("col_stats", "SELECT 'value' AS \"column\", round(avg(value), 6) AS mean, round(var_pop(value), 6) AS var, round(stddev_pop(value), 6) AS std FROM events UNION ALL SELECT 'user_id', round(avg(user_id), 6), round(var_pop(user_id), 6), round(stddev_pop(user_id), 6) FROM events")
def col_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return aggregate.column_moments(e, ["value", "user_id"]).withColumns({c: r6(c) for c in ("mean", "var", "std")})


@query("column_reductions", f"SELECT round(sum(value), 6) AS sum, max(value) AS max, min(value) AS min, round(covar_samp(value, signal_id), 4) AS cov, count(DISTINCT signal_id) AS uniques FROM {P}")
def column_reductions(spark, d):
    return points(spark, d).agg(r6(F.sum("value")).alias("sum"), F.max("value").alias("max"), F.min("value").alias("min"), F.round(F.covar_samp("value", "signal_id"), 4).alias("cov"), F.count_distinct("signal_id").alias("uniques"))


@query("outlier_majority", f"WITH c AS (SELECT CAST(floor(value) AS BIGINT) % 256 AS b, count(*) AS n FROM {P} GROUP BY 1) SELECT b AS byte, n, round(n / (SELECT sum(n) FROM c), 6) AS share, n / (SELECT sum(n) FROM c) > 0.6 AS dominant FROM c ORDER BY n DESC, b LIMIT 1")
def outlier_majority(spark, d):
    b = points(spark, d).select((F.floor("value") % 256).alias("byte"))
    return aggregate.byte_majority(b, "byte").withColumn("share", r6("share"))


@query("majority_vote", f"SELECT CAST(floor(value) AS BIGINT) AS byte, count(*) AS n FROM {P} WHERE idx < 2000 GROUP BY 1 ORDER BY n DESC, byte LIMIT 1")
def majority_vote(spark, d):
    return aggregate.majority_vote(points(spark, d).select("idx", F.floor("value").alias("byte")), "byte")


@query("outlier_split", f"WITH b AS (SELECT idx, CAST(floor(value) AS BIGINT) AS byte FROM {P}), m AS (SELECT byte FROM b GROUP BY byte ORDER BY count(*) DESC, byte LIMIT 1) SELECT idx, byte FROM b WHERE byte <> (SELECT byte FROM m) AND byte > 69")
def outlier_split(spark, d):
    b = points(spark, d).select("idx", F.floor("value").alias("byte"))
    top = aggregate.byte_majority(b, "byte").select("byte")
    return b.join(F.broadcast(top), "byte", "left_anti").filter("byte > 69").select("idx", "byte")


@query("byte_sum_lanes", f"SELECT idx % 32 AS lane, CAST(sum(CAST(floor(value) AS BIGINT) % 256) % 256 AS BIGINT) AS sum FROM {P} GROUP BY 1")
def byte_sum_lanes(spark, d):
    return aggregate.wrapping_byte_sum(points(spark, d).select("idx", (F.floor("value") % 256).alias("b")), "b")


@query("leading_zeros", f"WITH c AS (SELECT CAST(floor(value * 256) AS BIGINT) AS code FROM {P}) SELECT CAST(CASE WHEN code = 0 THEN 64 ELSE 63 - CAST(floor(log2(code)) AS INTEGER) END AS INTEGER) AS zeros, count(*) AS n FROM c GROUP BY 1")
def leading_zeros(spark, d):
    return aggregate.leading_zero_histogram(points(spark, d).select(Fixed.of(2).code(F.col("value")).alias("code")), "code")


@query("bit_split", f"SELECT idx, CAST(floor(value * 256) AS BIGINT) >> 8 AS high, CAST(floor(value * 256) AS BIGINT) & 255 AS low, CAST(CASE WHEN floor(value * 256) = 0 THEN 0 ELSE floor(log2(floor(value * 256))) + 1 END AS INTEGER) AS width FROM {P}")
def bit_split(spark, d):
    code = Fixed.of(2).code(F.col("value"))
    high, low = split_bits(code, 8)
    return points(spark, d).select("idx", high.alias("high"), low.alias("low"), bit_width(code).alias("width"))


@query("signal_counts", f"SELECT kind, signal_id // 50 AS band, count(*) AS n FROM {P} GROUP BY CUBE (kind, signal_id // 50)")
def signal_counts(spark, d):
    return points(spark, d).withColumn("band", F.floor(F.col("signal_id") / 50)).cube("kind", "band").agg(F.count("*").alias("n"))


@query("taxed_revenue", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def taxed_revenue(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").filter(F.col("l_shipdate") < F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


# ------------------------------------------------------------- hierarchy index
def _hierarchy_sql(base: int, levels: int) -> str:
    agg = "min(idx) AS start, max(idx) + 1 AS \"end\", max(value) AS max, min(value) AS min, round(sum(value), 6) AS sum, count(*) AS count"
    parts = [f"SELECT {level} AS level, idx // {base * 8 ** (level - 1)} AS node, {agg} FROM {P} GROUP BY 2" + (f" HAVING count(*) = {base * 8 ** (level - 1)}" if level > 1 else "") for level in range(1, levels + 1)]
    return " UNION ALL ".join([f"SELECT 0 AS level, 0::BIGINT AS node, {agg} FROM {P}", *parts])


@query("stats_hierarchy", _hierarchy_sql(100, 3))
def stats_hierarchy(spark, d):
    return stats_index.build(points(spark, d), 3, base=100).withColumn("sum", r6("sum")).drop("avg")


@query("range_max_index", f"SELECT min(idx) AS start, max(idx) + 1 AS \"end\", {STATS}, round(avg(value), 6) AS avg FROM {P} WHERE idx >= 123 AND idx < 987")
def range_max_index(spark, d):
    p = points(spark, d)
    return stats_index.range_stats(stats_index.build(p, 2, base=50), p, 123, 987, 2, base=50).withColumns({"sum": r6("sum"), "avg": r6("avg")})


@query("range_index_wide", f"SELECT min(idx) AS start, max(idx) + 1 AS \"end\", {STATS}, round(avg(value), 6) AS avg FROM {P} WHERE idx >= 70 AND idx < 9950")
def range_index_wide(spark, d):
    p = points(spark, d)
    return stats_index.range_stats(stats_index.build(p, 3, base=100), p, 70, 9950, 3, base=100).withColumns({"sum": r6("sum"), "avg": r6("avg")})


# --------------------------------------------------------------------- windows
@query("window_max_count", f"SELECT idx // 500 AS \"window\", max(value) AS max FROM {P} GROUP BY 1")
def window_max_count(spark, d):
    return window.count_window_max(points(spark, d), 0, None, 500)


@query("window_max_fixed", f"SELECT (idx - 500) // 240 AS \"window\", max(floor(value * 256) / 256) AS max FROM {P} WHERE idx >= 500 GROUP BY 1")
def window_max_fixed(spark, d):
    return window.count_window_max(filters.materialize(points(spark, d), Fixed.of(2)), 500, None, 240)


@query("window_max_price", "WITH o AS (SELECT o_orderkey AS idx, o_totalprice AS value FROM orders) SELECT idx // 1680 AS \"window\", max(value) AS max FROM o GROUP BY 1")
def window_max_price(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("value"))
    return window.count_window_max(o, 0, None, 1680)


@query("paa_mean", f"SELECT idx // 8 AS chunk, round(avg(value), 6) AS mean FROM {P} GROUP BY 1")
def paa_mean(spark, d):
    return window.chunk_means(points(spark, d), 8).withColumn("mean", r6("mean"))


@query("paa_mean_full", f"SELECT idx // 24 AS chunk, round(sum(value) / 24, 6) AS mean FROM {P} GROUP BY 1")
def paa_mean_full(spark, d):
    return window.chunk_means(points(spark, d), 24, full_divisor=True).withColumn("mean", r6("mean"))


@query("paa_reconstruct", f"SELECT idx, round(avg(value) OVER (PARTITION BY idx // 8), 6) AS value FROM {P}")
def paa_reconstruct(spark, d):
    return window.reconstruct_means(points(spark, d), 8).select("idx", r6("value").alias("value"))


@query("paa_sum_estimate", f"SELECT round(sum(m) * 24, 4) AS sum FROM (SELECT avg(value) AS m FROM {P} GROUP BY idx // 24)")
def paa_sum_estimate(spark, d):
    return window.chunk_means(points(spark, d), 24).agg(F.round(F.sum("mean") * 24, 4).alias("sum"))


@query("first_difference", f"SELECT idx, round(value - coalesce(lag(value) OVER (ORDER BY idx), 0), 6) AS diff FROM {P}")
def first_difference(spark, d):
    return window.first_difference(points(spark, d)).select("idx", r6("diff").alias("diff"))


@query("signal_difference", f"SELECT idx, signal_id, round(value - coalesce(lag(value) OVER (PARTITION BY signal_id ORDER BY idx), 0), 6) AS diff FROM {P}")
def signal_difference(spark, d):
    return window.first_difference(points(spark, d), by="signal_id").select("idx", "signal_id", r6("diff").alias("diff"))


ZZ = f"WITH c AS (SELECT idx, CAST(floor(value * 256) AS BIGINT) AS code FROM {P}), e AS (SELECT idx, code, code - coalesce(lag(code) OVER (ORDER BY idx), code) AS dl FROM c)"


@query("zigzag_delta", f"{ZZ} SELECT idx, CASE WHEN dl < 0 THEN -2 * dl - 1 ELSE 2 * dl END AS zz, code FROM e")
def zigzag_delta(spark, d):
    rows = points(spark, d).select("idx", Fixed.of(2).code(F.col("value")).alias("code"))
    return window.zigzag_delta(rows, "code").select("idx", "zz", "code")


@query("zigzag_round_trip", f"SELECT idx, CASE WHEN idx % 2 = 0 THEN 2 * idx ELSE 2 * idx - 1 END AS zz, CASE WHEN idx % 2 = 0 THEN idx ELSE -idx END AS back FROM {P}")
def zigzag_round_trip(spark, d):
    x = F.when(F.col("idx") % 2 == 0, F.col("idx")).otherwise(-F.col("idx"))
    return points(spark, d).select("idx", zigzag(x).alias("zz"), unzigzag(zigzag(x)).alias("back"))


@query("frame_of_reference", f"WITH c AS (SELECT idx, CAST(floor(value * 256) AS BIGINT) AS code FROM {P}), b AS (SELECT min(code) AS base, max(code) - min(code) AS s FROM c) SELECT idx, code - base AS \"offset\", CAST(CASE WHEN s = 0 THEN 0 ELSE floor(log2(s)) + 1 END AS INTEGER) AS width FROM c, b")
def frame_of_reference(spark, d):
    rows = points(spark, d).select("idx", Fixed.of(2).code(F.col("value")).alias("code"))
    return window.frame_of_reference(rows, "code").select("idx", "offset", "width")


SEG = f"n AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY idx) AS rn, count(*) OVER (PARTITION BY signal_id) AS cnt FROM {P}), s AS (SELECT signal_id, (rn - 1) // 10 AS seg_id, min(ts) AS ts, count(*) AS size, list(value ORDER BY idx) AS data FROM n WHERE (rn - 1) // 10 < (cnt - 1) // 10 GROUP BY 1, 2)"


@query("segmentize", f"WITH {SEG} SELECT signal_id, seg_id, ts, CAST(size AS INTEGER) AS size, round(list_sum(data), 6) AS total, data[1] AS first FROM s")
def segmentize(spark, d):
    s = window.segmentize(points(spark, d), 10)
    return s.select("signal_id", "seg_id", "ts", "size", r6(F.aggregate("data", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.element_at("data", 1).alias("first"))


@query("segmentize_skewed", f"WITH {SEG} SELECT signal_id, seg_id, ts, CAST(size AS INTEGER) AS size, round(list_sum(data), 6) AS total FROM s")
def segmentize_skewed(spark, d):
    s = window.segmentize(points(spark, d), 10, skewed=True)
    return s.select("signal_id", "seg_id", "ts", "size", r6(F.aggregate("data", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("segment_chain", f"WITH {SEG} SELECT signal_id, seg_id, ts, lag(seg_id) OVER w AS prev_seg, lag(ts) OVER w AS prev_ts FROM s WINDOW w AS (PARTITION BY signal_id ORDER BY ts, seg_id)")
def segment_chain(spark, d):
    return window.chain(window.segmentize(points(spark, d), 10)).select("signal_id", "seg_id", "ts", "prev_seg", "prev_ts")


@query("chain_join", f"WITH {SEG}, c AS (SELECT *, lag(ts) OVER (PARTITION BY signal_id ORDER BY ts, seg_id) AS prev_ts FROM s) SELECT c.signal_id, c.seg_id, q.seg_id AS prev_seg FROM c LEFT JOIN c q ON c.signal_id = q.signal_id AND c.prev_ts = q.ts")
def chain_join(spark, d):
    c = window.chain(window.segmentize(points(spark, d), 10)).drop("prev_seg")
    return joins.with_previous(c).select("signal_id", "seg_id", "prev_seg")


@query("latest_n_segments", f"WITH {SEG} SELECT signal_id, seg_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY ts DESC, seg_id DESC) AS rn FROM s) WHERE rn <= 3")
def latest_n_segments(spark, d):
    return window.latest_segments(window.segmentize(points(spark, d), 10), 3).select("signal_id", "seg_id", "rank")


@query("time_lapse", f"WITH n AS (SELECT *, (row_number() OVER (PARTITION BY signal_id ORDER BY idx) - 1) // 10 AS seg_id FROM {P}) SELECT idx, seg_id, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY signal_id, seg_id)) AS lapse FROM n")
def time_lapse(spark, d):
    return window.time_lapse(points(spark, d), 10).select("idx", "seg_id", "lapse")


@query("context_prediction", f"WITH c AS (SELECT idx, signal_id, CAST(floor(value) AS BIGINT) % 4 AS code FROM {P}), h AS (SELECT *, coalesce(lag(code, 1) OVER w, 0) AS h1, coalesce(lag(code, 2) OVER w, 0) AS h2 FROM c WINDOW w AS (PARTITION BY signal_id ORDER BY idx)) SELECT idx, code, coalesce(last_value(code) OVER (PARTITION BY signal_id, h1, h2 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS predicted, code - coalesce(last_value(code) OVER (PARTITION BY signal_id, h1, h2 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS residual FROM h")
def context_prediction(spark, d):
    rows = points(spark, d).select("idx", "signal_id", (F.floor("value") % 4).alias("code"))
    return window.context_prediction(rows, "code", 2).select("idx", "code", "predicted", "residual")


XOR = "xor(CAST(value AS BIT), CAST(prev AS BIT))::VARCHAR"


@query("xor_zeros", f"WITH p AS (SELECT idx, signal_id, value, lag(value) OVER (PARTITION BY signal_id ORDER BY idx) AS prev FROM {P}), x AS (SELECT *, CASE WHEN prev IS NOT NULL THEN {XOR} END AS bits FROM p) SELECT idx, signal_id, value, CAST(CASE WHEN strpos(bits, '1') = 0 THEN 64 ELSE strpos(bits, '1') - 1 END AS INTEGER) AS leading, CAST(CASE WHEN strpos(bits, '1') = 0 THEN 64 ELSE strpos(reverse(bits), '1') - 1 END AS INTEGER) AS trailing FROM x")
def xor_zeros(spark, d):
    return window.bits_in_common(points(spark, d).select("idx", "signal_id", "value"))


# ---------------------------------------------------------------- sets and sort
def _users(spark, d, kind):
    return points(spark, d).filter(F.col("kind") == kind).select("signal_id")


A, B = ("(SELECT DISTINCT user_id AS signal_id FROM events WHERE event_type = '%s' AND value > 60)" % k for k in ("click", "purchase"))


def _pair(spark, d):
    p = points(spark, d).filter("value > 60")
    return tuple(p.filter(F.col("kind") == k).select("signal_id").distinct() for k in ("click", "purchase"))


@query("set_union", f"SELECT * FROM {A} UNION SELECT * FROM {B}")
def set_union(spark, d):
    return sets.union(*_pair(spark, d))


@query("set_difference", f"SELECT * FROM {A} EXCEPT SELECT * FROM {B}")
def set_difference(spark, d):
    return sets.difference(*_pair(spark, d))


@query("set_symmetric_difference", f"(SELECT * FROM {A} EXCEPT SELECT * FROM {B}) UNION ALL (SELECT * FROM {B} EXCEPT SELECT * FROM {A})")
def set_symmetric_difference(spark, d):
    return sets.symmetric_difference(*_pair(spark, d))


@query("set_intersection", f"SELECT * FROM {A} INTERSECT SELECT * FROM {B}")
def set_intersection(spark, d):
    return sets.intersection(*_pair(spark, d))


@query("set_append", f"SELECT * FROM {A} UNION SELECT * FROM {B}")
def set_append(spark, d):
    return sets.append(*_pair(spark, d))


@query("topk", f"SELECT idx, value FROM {P} ORDER BY value, idx LIMIT 20")
def top_k(spark, d):
    return topk.smallest(points(spark, d).select("idx", "value"), 20, "value", "idx")


@query("topk_per_signal", f"SELECT signal_id, idx, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY value, idx) AS rank FROM {P}) WHERE rank <= 3")
def topk_per_signal(spark, d):
    return topk.smallest_per(points(spark, d).select("signal_id", "idx", "value"), 3, "signal_id", "value", "idx")


@query("unique_with_indices", f"SELECT idx, kind, CAST(dense_rank() OVER (ORDER BY kind) - 1 AS INTEGER) AS index FROM {P}")
def unique_with_indices(spark, d):
    return topk.dense_index(points(spark, d).select("idx", "kind"), "kind").select("idx", "kind", "index")


@query("argsort", f"SELECT signal_id, row_number() OVER (PARTITION BY signal_id ORDER BY value, position) - 1 AS rank, position FROM (SELECT signal_id, value, row_number() OVER (PARTITION BY signal_id ORDER BY idx) - 1 AS position FROM {P})")
def argsort(spark, d):
    return topk.argsorted(points(spark, d).select("signal_id", "idx", "value"), "signal_id", "value", "idx")


@query("argsort_arrays", f"WITH r AS (SELECT idx // 100 AS node, idx, value, row_number() OVER (PARTITION BY idx // 100 ORDER BY idx) - 1 AS position FROM {P}) SELECT node, list(CAST(position AS INTEGER) ORDER BY value, position) AS positions FROM r GROUP BY 1")
def argsort_arrays(spark, d):
    """Positions of each segment of 100 points in order of their values."""
    rows = points(spark, d).groupBy(F.floor(F.col("idx") / 100).alias("node")).agg(F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("r"))
    return rows.select("node", topk.argsort(F.col("r.value")).alias("positions"))


@query("set_contains", "SELECT v AS signal_id, v IN (SELECT user_id FROM events) AS found FROM (VALUES (CAST(7 AS BIGINT)), (CAST(-5 AS BIGINT))) t(v)")
def set_contains(spark, d):
    users = points(spark, d).select("signal_id")
    return spark.createDataFrame([(v, sets.contains(users, "signal_id", v)) for v in (7, -5)], "signal_id long, found boolean")


@query("extremes_second_wins", f"SELECT idx, CASE WHEN isnan(a) OR isnan(b) THEN b WHEN a > b THEN a ELSE b END AS greatest, CASE WHEN isnan(a) OR isnan(b) THEN b WHEN a < b THEN a ELSE b END AS least FROM (SELECT idx, CASE WHEN idx % 10 = 3 THEN 'nan'::DOUBLE ELSE value END AS a, CAST(signal_id AS DOUBLE) AS b FROM {P})")
def extremes_second_wins(spark, d):
    a = F.when(F.col("idx") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("value"))
    b = F.col("signal_id").cast("double")
    return points(spark, d).select("idx", second_wins_max(a, b).alias("greatest"), second_wins_min(a, b).alias("least"))


@query("bits_to_int", f"SELECT idx, idx AS number FROM {P}")
def bits_to_number(spark, d):
    """Numbers written as binary digits, least significant first, and read again."""
    return points(spark, d).select("idx", bits_to_int(F.reverse(F.bin("idx"))).alias("number"))
