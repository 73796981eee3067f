"""Sources, streams and the budgeted store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate
from ..operators.filters import range_filter
from ..operators.window import segmentize
from ..session import shared_dir
from ..sources import signals
from ..streaming import pipeline
from ..streaming.segmenter import segments
from .registry import points, query, r6, vectors


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"


@query("parquet_column", "SELECT count(*) AS n, round(sum(value), 6) AS sum, max(value) AS max FROM events WHERE value > 50")
def parquet_column(spark, d):
    from ..sources.store import read_column, write_column

    path = scratch(spark)
    write_column(points(spark, d).select("value"), path, "gzip")
    return range_filter(read_column(spark, path), 50).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("sum"), F.max("value").alias("max"))


@query("csv_signal", "SELECT count(*) AS n, round(sum(value), 6) AS sum FROM events")
def csv_signal(spark, d):
    """Two leading fields are skipped; a word that is no number is dropped."""
    path = scratch(spark)
    points(spark, d).select(F.concat_ws(",", "idx", "kind", F.col("value").cast("string"), F.lit("none")).alias("line")).write.text(path)
    return signals.signal_csv(spark, path, skip=2).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("sum"))


@query("dense_positions", "SELECT event_id AS idx, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS position FROM events")
def dense_positions(spark, d):
    return signals.numbered(points(spark, d).select("idx", "value"), ["value", "idx"], "position").select("idx", "position")


@query("segment_store", "SELECT user_id AS signal_id, count(*) // 10 AS n FROM events WHERE user_id = 7 GROUP BY 1 HAVING count(*) >= 10")
def segment_store(spark, d):
    from ..sources.store import SegmentStore

    store = SegmentStore(spark, scratch(spark), 8)
    store.put(segmentize(points(spark, d), 10, flush_tail=True).filter("size = 10"))
    return store.scan().filter("signal_id = 7").groupBy("signal_id").agg(F.count("*").alias("n"))


@query("stream_segments", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS cnt FROM events) SELECT user_id AS signal_id, (rn - 1) // 10 AS seg_id, CAST(count(*) AS INTEGER) AS size, round(sum(value), 6) AS total FROM n WHERE (rn - 1) // 10 < (cnt - 1) // 10 GROUP BY 1, 2")
def stream_segments(spark, d):
    """The events as a stream of files, segmented with state; one row a segment."""
    base = scratch(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    rows = stream.select(F.col("event_id").alias("idx"), F.col("user_id").alias("signal_id"), "ts", "value")
    q = segments(rows, 10).writeStream.format("parquet").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("signal_id", "seg_id", "size", r6(F.aggregate("data", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    "budgeted_recode",
    "WITH n AS (SELECT event_id AS idx, user_id AS signal_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS cnt FROM events), s AS (SELECT *, rn // 20 AS seg_id, CAST(sign(value) * floor(abs(value) * 256) AS BIGINT) AS code FROM n WHERE rn // 20 < (cnt - 1) // 20), "
    "g AS (SELECT signal_id, seg_id, arg_min(ts, idx) AS ts, count(*) AS size, max(code) - min(code) AS w FROM s GROUP BY 1, 2), b AS (SELECT *, 20 + size * ((CASE WHEN w = 0 THEN 0 ELSE length(bin(w)) END + 7) // 8) AS bytes FROM g), "
    "o AS (SELECT *, sum(bytes) OVER (ORDER BY ts DESC, signal_id DESC, seg_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM b), m AS (SELECT s.*, avg(value) OVER (PARTITION BY signal_id, seg_id, (rn % 20) // 4) AS est FROM s) "
    "SELECT m.signal_id, m.seg_id, round(8 * ((any_value(size) + 3) // 4) / (8.0::DOUBLE * any_value(size)), 6) AS ratio, round(abs(max(value) - max(est)) / abs(max(value)), 6) AS max_error, round(abs(sum(value) - sum(est)) / abs(sum(value)), 6) AS sum_error FROM m JOIN o USING (signal_id, seg_id) WHERE total > 20000 GROUP BY 1, 2",
)
def budgeted_recode(spark, d):
    """Segments over the byte budget, recoded by piecewise averages, and their errors."""
    from ..codecs.transforms import Paa, reconstruct

    stored = pipeline.compress(segmentize(points(spark, d), 20), "buff", 100).withColumn("touched", F.col("ts"))
    old = pipeline.over_budget(stored, 20_000)
    lossy = reconstruct(old.drop("n_bytes"), Paa(4))
    out = pipeline.recoding_metrics(old, lossy)
    return out.select("signal_id", "seg_id", *[r6(c).alias(c) for c in ("ratio", "max_error", "sum_error")])


def _uniform(seed: int, stream: int, at: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', {seed}, {stream}, {at})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE)"


def _normal(seed: int, stream: int, at: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_uniform(seed, 2 * stream, at)})) * cos({_uniform(seed, 2 * stream + 1, at)} * (2 * pi())))"


def _summary(kind: str, value: str) -> str:
    return f"SELECT '{kind}' AS kind, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT {value} AS v FROM range(1000) t(id))"


@query("generators", _summary("normal", f"CAST(CAST({_normal(7, 0, 'id')} * 2.0 + 5.0 AS FLOAT) AS DOUBLE)") + " UNION ALL " + _summary("uniform", f"{_uniform(7, 0, 'id')} * 2.0 - 1.0"))
def generators(spark, d):
    parts = {"normal": signals.normal_signal(spark, 1000, 5.0, 2.0, 7), "uniform": signals.uniform_signal(spark, 1000, -1.0, 1.0, 7)}
    rows = [df.agg(F.lit(n).alias("kind"), F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std")) for n, df in parts.items()]
    return rows[0].union(rows[1])


BLOB = ", ".join(f"round(({_uniform(12, j, 'id % 4')} * 20 - 10) + {_normal(11, j, 'id')}, 6)" for j in range(3))


@query("blobs", f"SELECT id, CAST(id % 4 AS INTEGER) AS label, [{BLOB}] AS vector FROM range(2000) t(id)")
def blobs(spark, d):
    out = signals.blobs(spark, 2000, 3, 4, 11)
    return out.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query("circles", f"WITH c AS (SELECT id, id >= 500 AS inside, (CASE WHEN id >= 500 THEN (id - 500) / 500.0::DOUBLE ELSE id / 500.0::DOUBLE END) * (2 * pi()) AS a, CASE WHEN id >= 500 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS r FROM range(1000) t(id)) SELECT id, CAST(inside AS INTEGER) AS label, [round(r * cos(a) + {_normal(5, 0, 'id')} * 0.1::DOUBLE, 6), round(r * sin(a) + {_normal(5, 1, 'id')} * 0.1::DOUBLE, 6)] AS vector FROM c")
def circles(spark, d):
    out = signals.circles(spark, 1000, 0.5, 0.1, 5)
    return out.withColumn("vector", F.transform("vector", lambda x: F.round(x, 6)))


@query("labelled_series", "SELECT CAST(label AS INTEGER) AS label, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY 1")
def labelled_series(spark, d):
    """Series written as lines of a label and values, and read again."""
    path = scratch(spark)
    v = vectors(spark, d)
    v.select(F.concat_ws(",", F.col("label").cast("string"), F.transform("vector", lambda x: x.cast("double").cast("string"))).alias("line")).write.text(path)
    rows = signals.labelled_csv(spark, path)
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


@query("key_list", "SELECT user_id AS tag_id, count(*) AS n FROM events GROUP BY 1")
def key_list(spark, d):
    """A column of keys with a header, which does not parse and is dropped."""
    path = scratch(spark)
    points(spark, d).select(F.col("signal_id").cast("string").alias("tag")).write.option("header", True).csv(path)
    return signals.key_csv(spark, path).groupBy("tag_id").agg(F.count("*").alias("n"))


@query("gamma_table", "SELECT 'series' || event_id AS name, list_transform(range(14), lambda i: CAST(event_id + i AS INTEGER)) AS gammas, CAST(event_id + 7 AS INTEGER) AS gamma FROM events WHERE event_id < 500")
def gamma_table(spark, d):
    path = scratch(spark)
    numbers = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: (F.col("idx") + i).cast("string"))
    points(spark, d).filter("idx < 500").select(F.concat_ws(",", F.concat(F.lit("/data/series"), F.col("idx").cast("string")), numbers).alias("line")).write.text(path)
    return signals.gamma_table(spark, path)


@query("limited_points", "SELECT event_id AS idx, value FROM events ORDER BY event_id LIMIT 100")
def limited_points(spark, d):
    return signals.limited(points(spark, d).select("idx", "value"), 100)


@query("mean_throughput", "SELECT round(avg(CASE WHEN value >= 5 THEN value END), 6) AS throughput FROM events")
def mean_throughput(spark, d):
    """Throughputs that weren't measured are zeros."""
    rows = points(spark, d).select(F.when(F.col("value") < 5, 0.0).otherwise(F.col("value")).alias("comp_runtime"))
    return aggregate.mean_throughput(rows).select(r6("throughput").alias("throughput"))


U52 = _uniform(3, 0, "id")


@query("outlier_bytes", f"SELECT byte, count(*) AS n FROM (SELECT CAST(CASE WHEN id = 10000 // 3 THEN 0 WHEN id = 20000 // 3 THEN 255 WHEN {U52} < 0.9::DOUBLE THEN 69 ELSE floor({_uniform(3, 1, 'id')} * 256) END AS SMALLINT) AS byte FROM range(10000) t(id)) GROUP BY 1")
def outlier_bytes(spark, d):
    return signals.outlier_bytes(spark, 10_000, 0.9, 3).groupBy("byte").agg(F.count("*").alias("n"))


@query("sampled_positions", f"SELECT event_id AS idx FROM events WHERE {_uniform(0, 0, 'event_id')} < 0.1::DOUBLE")
def sampled_positions(spark, d):
    return signals.sampled_positions(points(spark, d), 0.1)
