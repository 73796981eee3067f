"""A budgeted store of segments: compress on arrival, recode when space runs short.

Each micro-batch is one table. Lossless sizes are taken per segment; the policy
picks the least recently touched segments of all batches until the budget is met
and recodes them in place; metrics of every recoding join the segments before and
after it by key.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import size
from ..codecs.transforms import Codec, for_ratio, halved, reconstruct
from ..operators.aggregate import relative_error
from ..operators.ranges import running_total
from ..session import kept
from .bandit import LOSSLESS_ARMS, LOSSY_ARMS, Bandit, band, reward


def compress(segments: DataFrame, method: str, scale: int) -> DataFrame:
    """Segments with the bytes that a lossless method takes."""
    measure = size.LOSSLESS[method]

    @F.pandas_udf("long")
    def n_bytes(data: pd.Series) -> pd.Series:
        return data.map(lambda v: measure(np.asarray(v, float), scale)).astype("int64")

    return segments.withColumn("n_bytes", n_bytes("data")).withColumn("method", F.lit(method))


def over_budget(segments: DataFrame, budget: int, touched: str = "touched") -> DataFrame:
    """The least recently touched segments whose removal brings the rest into budget.

    The running total is over one row for each segment, without its data, and by
    ranges of time.
    """
    keys = segments.select("signal_id", "seg_id", touched, "n_bytes")
    newest = [F.desc(touched), F.desc("signal_id"), F.desc("seg_id")]
    kept = running_total(keys, newest, "n_bytes", "_newer")
    over = kept.filter(F.col("_newer") + F.col("n_bytes") > budget)
    return segments.join(over.select("signal_id", "seg_id"), ["signal_id", "seg_id"], "left_semi")


def fill(segments: DataFrame, capacity: int, batch: int) -> DataFrame:
    """Fill of the pool and the thresholds that the daemons ask for."""
    n = segments.agg(F.count("*").alias("segments"), F.sum("n_bytes").alias("bytes"))
    return n.select("segments", "bytes", (F.col("bytes") / capacity).alias("fill"), (F.col("segments") >= batch).alias("batch_ready"))


def recoding_metrics(exact: DataFrame, lossy: DataFrame) -> DataFrame:
    """Relative errors of max and sum for each recoded segment."""
    stats = lambda c: (F.array_max(c), F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    a = exact.select("signal_id", "seg_id", *[s.alias(n) for s, n in zip(stats("data"), ("max", "sum"), strict=True)])
    b = lossy.select("signal_id", "seg_id", "n_bytes", "size", *[s.alias(f"e_{n}") for s, n in zip(stats("data"), ("max", "sum"), strict=True)])
    both = a.join(b, ["signal_id", "seg_id"])
    ratio = F.col("n_bytes") / (8.0 * F.col("size"))
    return both.select("signal_id", "seg_id", ratio.alias("ratio"), *[relative_error(F.col(c), F.col(f"e_{c}")).alias(f"{c}_error") for c in ("max", "sum")])


LEAST_RATIO = 1 / 64  # segments are not halved beyond it; nothing is ever dropped


@dataclass
class Ingest:
    """The store, and the driver's state between micro-batches.

    Segments lie in parts, which are tables below ``path``; ``state.json`` names the
    live ones and holds bandits and history, so that a restart goes on where the last
    batch ended and a replayed batch is skipped. Whenever the parts take more than
    ``budget`` bytes, the least recently touched segments of all batches are recoded
    (lossless ones to ``target``, or 0.25; lossy ones to half their ratio), and the
    parts that held them are written anew without the originals.

    ``bandit`` chooses codecs; without it the first arms are used. Bytes are those
    that the codecs take; segments that can't shrink further stay, over the budget.
    """

    path: str
    scale: int = 100
    budget: int = 1 << 20
    task: str = "sum"
    target: float | None = None
    bandit: bool = True
    lossless: Bandit = field(default_factory=lambda: Bandit(len(LOSSLESS_ARMS)))
    lossy: list[Bandit] = field(default_factory=lambda: [Bandit(len(LOSSY_ARMS)) for _ in range(3)])
    history: list[dict] = field(default_factory=list)
    parts: dict[str, int] = field(default_factory=dict)  # live parts and their bytes
    made: int = 0
    restored: bool = False

    def codec(self, ratio: float) -> tuple[int, Codec]:
        arm = self.lossy[band(ratio)].choose() if self.bandit else 0
        name = LOSSY_ARMS[arm]
        if name == "bufflossy" and ratio < 0.125:
            name = "paa"
        return arm, for_ratio(name, ratio, self.scale)

    # ------------------------------------------------------------------ state
    def restore(self, spark: SparkSession) -> None:
        """Take up the state that the last batch left, and remove parts it doesn't name."""
        if self.restored:
            return
        self.restored = True
        files = Folder(spark, self.path)
        if (text := files.read("state.json")) is not None:
            raw = json.loads(text)
            self.parts, self.made, self.history = raw["parts"], raw["made"], raw["history"]
            for b, dumped in zip([self.lossless, *self.lossy], raw["bandits"], strict=True):
                b.load(dumped)
        for name in files.names("parts"):
            if name not in self.parts:
                files.remove(f"parts/{name}")

    def save(self, spark: SparkSession) -> None:
        Folder(spark, self.path).write("state.json", json.dumps({"parts": self.parts, "made": self.made, "history": self.history, "bandits": [b.dump() for b in (self.lossless, *self.lossy)]}))

    def add(self, rows: DataFrame, tag: str = "parts") -> str:
        """A new part of these rows."""
        name = f"{self.made:06d}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{tag}/{name}")
        self.made += 1
        return name

    def segments(self, spark: SparkSession) -> DataFrame:
        """All segments of the store, with the part that holds each."""
        return reduce(DataFrame.unionByName, [spark.read.parquet(f"{self.path}/parts/{p}").withColumn("part", F.lit(p)) for p in sorted(self.parts)])

    def size(self, spark: SparkSession, name: str) -> int:
        return spark.read.parquet(f"{self.path}/parts/{name}").agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]

    # ----------------------------------------------------------------- batches
    def batch(self, segments: DataFrame, epoch: int) -> None:
        """One micro-batch: compress, store, and recode while the budget is exceeded."""
        spark = segments.sparkSession
        self.restore(spark)
        if any(h["epoch"] == epoch for h in self.history):
            return
        arm = self.lossless.choose() if self.bandit else 0
        fresh = compress(segments, LOSSLESS_ARMS[arm], self.scale).withColumns({"touched": F.col("ts"), "ratio": F.lit(1.0)})
        name = self.add(fresh)
        n, total, size = spark.read.parquet(f"{self.path}/parts/{name}").agg(F.count("*"), F.sum("n_bytes"), F.sum("size")).first()
        if n:
            self.parts[name] = total
            self.lossless.update(arm, 8 * size / max(1, total))
            entry = {"epoch": epoch, "segments": n, "method": LOSSLESS_ARMS[arm], "bytes": total, "recoded": 0}
            self.shrink(spark, entry)
            self.history.append(entry | {"stored": sum(self.parts.values())})
        self.save(spark)

    def shrink(self, spark: SparkSession, entry: dict) -> None:
        """Recode until the parts are within the budget, or can't shrink."""
        while sum(self.parts.values()) > self.budget:
            began = time.monotonic()
            store = self.segments(spark)
            small = F.col("ratio") <= LEAST_RATIO
            fixed = store.agg(F.coalesce(F.sum(F.when(small, F.col("n_bytes"))), F.lit(0))).first()[0]
            old = over_budget(store.filter(~small), max(0, self.budget - fixed))
            old = kept(old, "old-segments")
            levels = [r[0] for r in old.select("ratio").distinct().orderBy("ratio").collect()]  # a few halvings
            if not levels:
                return
            lossy = []
            for level in levels:
                ratio = (self.target or 0.25) if level == 1 else level / 2
                arm, codec = self.codec(ratio)
                rows = reconstruct(old.filter(F.col("ratio") == level).drop("n_bytes"), codec)
                lossy.append((ratio, arm, codec, rows.withColumns({"ratio": F.lit(float(ratio)), "method": F.lit(codec.name)})))
            recoded = reduce(DataFrame.unionByName, [x[3] for x in lossy])
            held = [r[0] for r in old.select("part").distinct().collect()]
            rest = store.filter(F.col("part").isin(held)).join(old.select("signal_id", "seg_id", "part"), ["signal_id", "seg_id", "part"], "left_anti")
            name = self.add(rest.unionByName(recoded).drop("part"))
            m = recoding_metrics(old, recoded.drop("ratio")).join(old.select("signal_id", "seg_id", F.col("ratio").alias("before")), ["signal_id", "seg_id"])
            m.write.mode("overwrite").parquet(f"{self.path}/metrics/{name}")
            took = max(1e-9, time.monotonic() - began)
            finite = lambda c: F.avg(F.when(F.col(c) < float("inf"), F.col(c)))  # noqa: E731  a segment whose truth is 0 has no relative error
            stats = spark.read.parquet(f"{self.path}/metrics/{name}").groupBy("before").agg(finite("max_error"), finite("sum_error"), F.avg("ratio"), F.count("*")).collect()
            for level, (ratio, arm, codec, _) in zip(levels, lossy, strict=True):
                e = next(r for r in stats if r["before"] == level)
                pay = reward(self.task, max_error=e[1] or 0.0, sum_error=e[2] or 0.0, ratio=e[3] or 1.0, throughput=e[4] / took)
                self.lossy[band(ratio)].update(arm, pay)
                entry["recoded"] += e[4]
                entry |= {"codec": codec.name, "reward": pay, "least_ratio": min(ratio, entry.get("least_ratio", 1.0))}
            for part in held:
                del self.parts[part]
            self.parts[name] = self.size(spark, name)
            self.save(spark)  # the originals go only when nothing names them
            for part in held:
                Folder(spark, self.path).remove(f"parts/{part}")

    def start(self, segments: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Run on a stream of segments."""
        return segments.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Folder:
    """Small files and names below a path, through Spark's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path
        self.fs = self.at("").getFileSystem(conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file is there whole, or as it was."""
        out = self.fs.create(self.at(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(
            self.fs.makeQualified(self.at(f"{name}.new")), self.fs.makeQualified(self.at(name)), self.overwrite()
        )

    def overwrite(self):
        kinds = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        found = self.jvm.java.util.ArrayList()
        for k in kinds:
            if k.toString() == "OVERWRITE":
                found.add(k)
        out = self.jvm.java.lang.reflect.Array.newInstance(found.get(0).getDeclaringClass(), 1)
        self.jvm.java.lang.reflect.Array.set(out, 0, found.get(0))
        return out

    def names(self, name: str) -> list[str]:
        if not self.fs.exists(self.at(name)):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))]

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def mode(name: str, path: str, **settings) -> Ingest:
    """The four ways to run: fixed or bandit codecs, offline (halving at 80 % of the
    budget) or online (a target ratio from the start, recoding at once).
    """
    kinds = {"offline": (False, False), "maboffline": (True, False), "online": (False, True), "mabonline": (True, True)}
    if name not in kinds:
        raise ValueError(f"no mode {name}; one of {', '.join(kinds)}")
    bandit, online = kinds[name]
    budget = settings.pop("budget", 1 << 20)
    target = settings.pop("target", 0.25) if online else None
    return Ingest(path, budget=int(budget * (0.01 if online else 0.8)), target=target, bandit=bandit, **settings)


def throughput(query) -> dict:
    """Points, seconds and points a second of a stream, from its progress."""
    done = query.recentProgress
    points = sum(p["numInputRows"] for p in done)
    seconds = sum(p["durationMs"].get("triggerExecution", 0) for p in done) / 1000
    return {"points": points, "seconds": seconds, "points_per_second": points / seconds if seconds else 0.0}


def recode(codec: Codec, times: int = 1) -> Codec:
    """The codec after being halved some times."""
    for _ in range(times):
        codec = halved(codec)
    return codec
