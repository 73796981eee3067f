"""Streams agree with batches; bandits learn; the budget is kept."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.codecs.transforms import Paa
from tidegauge.operators.window import segmentize
from tidegauge.sources import config, signals
from tidegauge.streaming import bandit, pipeline
from tidegauge.streaming.segmenter import cut, segments


def frame(values):
    return pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=len(values), freq="s"), "value": values})


def test_tail_stays():
    out, state = cut(1, None, frame([1.0, 2, 3, 4]), 2)
    assert [o[5] for o in out] == [[1, 2]] and state[3] == [3, 4]
    more, state = cut(1, state, frame([5.0]), 2)
    assert [o[5] for o in more] == [[3, 4]] and more[0][3] == out[0][2] and state[3] == [5]


def test_stream_is_batch(spark, tmp_path):
    rows = [(i, i % 3, 1_700_000_000 + i, float(i % 7)) for i in range(200)]
    points = spark.createDataFrame(rows, "idx long, signal_id long, t long, value double").select("idx", "signal_id", F.timestamp_seconds("t").alias("ts"), "value")
    for k in range(4):  # one file for each trigger, in order
        points.filter((F.col("idx") >= 50 * k) & (F.col("idx") < 50 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = segments(stream, 10).writeStream.format("memory").queryName("got").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.signal_id, r.seg_id): list(r.data) for r in spark.table("got").collect()}
    want = {(r.signal_id, r.seg_id): list(r.data) for r in segmentize(points, 10).collect()}
    assert got == want and len(got) == sum((n - 1) // 10 for n in (67, 67, 66))


def test_flush_tail(spark):
    points = spark.range(25).select(F.col("id").alias("idx"), F.lit(1).cast("long").alias("signal_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("value"))
    assert segmentize(points, 10).count() == 2
    assert segmentize(points, 10, flush_tail=True).count() == 3


def test_bandit_prefers_the_better_arm():
    b = bandit.Bandit(3, epsilon=0.1, seed=4)
    for _ in range(500):
        arm = b.choose()
        b.update(arm, (1.0, 5.0, 2.0)[arm])
    assert b.best() == 1
    twin = bandit.Bandit(3)
    twin.load(b.dump())
    assert [twin.choose() for _ in range(20)] == [b.choose() for _ in range(20)]


def test_rewards():
    assert bandit.size_reward(20_000) == 4.0
    assert bandit.aggregate_reward(0) == 20.0 and bandit.aggregate_reward(0.01) == pytest.approx(2)
    assert bandit.reward("ml", accuracy=0.9, ratio=0.5) == pytest.approx(0.6)
    assert bandit.reward("sum_ml", accuracy=1.0, sum_error=0.1) == pytest.approx(10.3)
    assert [bandit.band(x) for x in (0.3, 0.2, 0.1)] == [0, 1, 2]
    with pytest.raises(ValueError, match="no task"):
        bandit.reward("none")


def test_budget(spark, tmp_path, monkeypatch):
    """Over several batches and a restart the store keeps its budget and every segment."""
    rows = spark.range(4000).select(F.col("id").alias("idx"), (F.col("id") % 4).alias("signal_id"), F.timestamp_seconds("id").alias("ts"), F.round(F.rand(3) * 50, 2).alias("value"))
    seg = segmentize(rows, 25).cache()
    steps = [seg.filter(f"seg_id >= {a} AND seg_id < {a + 13}") for a in (0, 13, 26)]
    job = pipeline.Ingest(str(tmp_path), budget=6000, target=0.25)
    used = lambda: spark.read.parquet(*[str(p) for p in sorted((tmp_path / "parts").iterdir())])
    for epoch, step in enumerate(steps):
        if epoch == 2:  # a new process goes on from the files
            values = [b.values for b in (job.lossless, *job.lossy)]
            (tmp_path / "parts" / "999999").mkdir()  # left by a batch that was cut short
            job = pipeline.Ingest(str(tmp_path), budget=6000, target=0.25)
            job.restore(spark)
            assert [b.values for b in (job.lossless, *job.lossy)] == values and len(job.history) == 2
        job.batch(step, epoch)
        here = used()
        assert here.agg(F.sum("n_bytes")).first()[0] == sum(job.parts.values()) <= 6000
        assert here.select("signal_id", "seg_id").distinct().count() == here.count() == sum(h["segments"] for h in job.history)
    assert [h["epoch"] for h in job.history] == [0, 1, 2] and job.history[-1]["recoded"] > 0
    assert used().agg(F.min("ratio")).first()[0] < 0.25  # halved again
    newest, oldest = used().agg(F.max_by("ratio", "touched"), F.min_by("ratio", "touched")).first()
    assert newest >= oldest
    before = used().count()
    job.batch(steps[2], 2)  # a replay
    assert used().count() == before
    monkeypatch.setattr(pipeline, "LEAST_RATIO", 0.25)
    tight = pipeline.Ingest(str(tmp_path / "tight"), budget=10, bandit=False)
    tight.batch(steps[0], 0)
    assert sum(tight.parts.values()) > 10 and sum(h["segments"] for h in tight.history) == steps[0].count()
    m = pipeline.recoding_metrics(seg, pipeline.reconstruct(seg, Paa(1)))
    assert m.agg(F.max("sum_error")).first()[0] < 1e-12
    assert pipeline.recode(Paa(2), 3).window == 16


def test_modes(tmp_path):
    online = pipeline.mode("mabonline", str(tmp_path), budget=1000, target=0.1)
    assert (online.budget, online.target, online.bandit) == (10, 0.1, True)
    assert pipeline.mode("offline", str(tmp_path), budget=1000).budget == 800
    assert pipeline.mode("offline", str(tmp_path)).codec(0.25)[1].name == "bufflossy"
    with pytest.raises(ValueError, match="no mode"):
        pipeline.mode("x", str(tmp_path))


TOML = """
segment_size = 50
[buffer]
buf_size = 150
[clients.a]
id = 3
type = "gen"
gen_type = "normal"
amount = 500
interval = 0.5
params = {mean = 4.0, std = 0.5}
[clients.b]
type = "gen"
gen_type = "uniform"
amount = "100"
frequency = 2
params = {low = 0.0, high = 1.0}
"""


def test_config(spark):
    c = config.parse(TOML)
    assert c.segment_size == 50 and c.clients[0].interval == 0.5 and c.clients[1].interval == 2 and c.clients[1].amount == 100
    p = config.points(spark, c.clients[0], seed=1)
    n, mean = p.agg(F.count("*"), F.avg("value")).first()
    assert n == 500 and abs(mean - 4) < 0.1
    assert p.first().signal_id == 3


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,1.5,2\nb,oops,3\n")
    rows = signals.signal_csv(spark, str(tmp_path / "x.csv"), skip=1)
    assert [r.value for r in signals.numbered(rows, ["line", "field"]).orderBy("idx").collect()] == [1.5, 2, 3]
    assert signals.rejected_cells(spark, str(tmp_path / "x.csv"), skip=1).first()[0] == 1
    (tmp_path / "l.csv").write_text("1,0.5,0.25\n2,1,2\n")
    got = signals.labelled_csv(spark, str(tmp_path / "l.csv")).orderBy("series_id").collect()
    assert [(r.label, r.pixels) for r in got] == [(1, [0.5, 0.25]), (2, [1, 2])]
    assert signals.labelled_csv(spark, str(tmp_path / "l.csv"), skip_first=True).count() == 1
    (tmp_path / "k.csv").write_text("id\n4\n5\n")
    assert sorted(r.tag_id for r in signals.key_csv(spark, str(tmp_path / "k.csv")).collect()) == [4, 5]
    (tmp_path / "g.csv").write_text("/d/Coffee," + ",".join(map(str, range(14))) + "\n")
    assert signals.gamma_table(spark, str(tmp_path / "g.csv")).first().gamma == 7


def test_generators(spark):
    b = {r.byte: r["count"] for r in signals.outlier_bytes(spark, 1000, 1.0, 5).groupBy("byte").count().collect()}
    assert b == {69: 998, 0: 1, 255: 1}
    labels = {r.label: r["count"] for r in signals.blobs(spark, 90, 2, 3, 1).groupBy("label").count().collect()}
    assert labels == {0: 30, 1: 30, 2: 30}
    r = signals.circles(spark, 40, 0.5, 0.0, 1).select("label", F.sqrt(F.col("vector")[0] ** 2 + F.col("vector")[1] ** 2).alias("r"))
    assert {(x.label, round(x.r, 6)) for x in r.collect()} == {(0, 1.0), (1, 0.5)}
