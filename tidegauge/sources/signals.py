"""Sources: signal files, labelled series, generators and column files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.domain import signed_code, unsigned_code
from ..operators.ranges import numbered  # noqa: F401  line and field order becomes a position


def signal_csv(spark: SparkSession, path: str, skip: int = 0, delimiter: str = ",") -> DataFrame:
    """Numbers of a delimited file without a header, as one stream: line, field, value.

    The first ``skip`` fields of each line are dropped, and cells that don't parse.
    ``line`` is a byte-ordered line id; use ``numbered`` for dense positions.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    cells = F.slice(F.split("value", _quoted(delimiter)), F.lit(skip + 1), F.greatest(F.lit(0), F.size(F.split("value", _quoted(delimiter))) - skip))
    rows = lines.select("line", F.posexplode(cells).alias("field", "cell"))
    return rows.select("line", "field", F.expr("try_cast(trim(cell) AS double)").alias("value")).filter("value IS NOT NULL")


def rejected_cells(spark: SparkSession, path: str, skip: int = 0, delimiter: str = ",") -> DataFrame:
    """How many cells ``signal_csv`` drops."""
    cells = F.explode(F.split("value", _quoted(delimiter))) if not skip else F.explode(F.slice(F.split("value", _quoted(delimiter)), skip + 1, 1 << 20))
    rows = spark.read.text(path).select(cells.alias("cell"))
    return rows.agg(F.count_if(F.expr("try_cast(trim(cell) AS double)").isNull()).alias("rejected"))


def _quoted(delimiter: str) -> str:
    return "\\Q" + delimiter + "\\E"


def unsigned_csv(spark: SparkSession, path: str, scale: float, skip: int = 0, delimiter: str = ",") -> DataFrame:
    return signal_csv(spark, path, skip, delimiter).withColumn("value", unsigned_code(F.col("value"), scale))


def signed_csv(spark: SparkSession, path: str, scale: float, skip: int = 0, delimiter: str = ",") -> DataFrame:
    return signal_csv(spark, path, skip, delimiter).withColumn("value", signed_code(F.col("value"), scale))


def labelled_csv(spark: SparkSession, path: str, skip_first: bool = False) -> DataFrame:
    """Lines ``label,v1,..,vm`` as label and pixels; optionally without each file's first line."""
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("series_id"), F.col("_metadata.file_path").alias("file"))
    if skip_first:
        first = rows.groupBy("file").agg(F.min("series_id").alias("series_id"))
        rows = rows.join(F.broadcast(first), ["file", "series_id"], "left_anti")
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c).cast("double"))
    return rows.select("series_id", F.element_at(cells, 1).cast("int").alias("label"), F.slice(cells, F.lit(2), F.size(cells) - 1).alias("pixels"))


def dictionary(spark: SparkSession, path: str, delimiter: str = ",") -> np.ndarray:
    """A small file of landmark series as a matrix."""
    return np.array([[float(c) for c in r.value.split(delimiter)] for r in spark.read.text(path).collect()])


def gamma_table(spark: SparkSession, path: str) -> DataFrame:
    """``path,int x 14`` lines: the path's last part, all numbers, and the eighth."""
    cells = F.split("value", ",")
    numbers = F.transform(F.slice(cells, F.lit(2), F.size(cells) - 1), lambda c: F.trim(c).cast("int"))
    return spark.read.text(path).select(F.element_at(F.split(cells[0], "/"), -1).alias("name"), numbers.alias("gammas"), F.element_at(numbers, 8).alias("gamma"))


def key_csv(spark: SparkSession, path: str, name: str = "tag_id") -> DataFrame:
    """A column of integers; a header does not parse and is dropped."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) AS bigint)").alias(name)).dropna()


def uniform(at: Column, seed: int, stream: int = 0) -> Column:
    """A number in [0, 1) for a position: 52 bits of an MD5, so it is the same however
    rows are dealt, and after an executor is lost.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(stream)), at.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(at: Column, seed: int, stream: int = 0) -> Column:
    """A standard normal number for a position, by Box and Muller."""
    return F.sqrt(F.lit(-2.0) * F.ln(1.0 - uniform(at, seed, 2 * stream))) * F.cos(uniform(at, seed, 2 * stream + 1) * (2 * np.pi))


def normal_signal(spark: SparkSession, n: int, mean: float, std: float, seed: int) -> DataFrame:
    """Normal samples, through single precision."""
    x = (normal(F.col("id"), seed) * std + mean).cast("float").cast("double")
    return spark.range(n).select(F.col("id").alias("idx"), x.alias("value"))


def uniform_signal(spark: SparkSession, n: int, low: float, high: float, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("idx"), (uniform(F.col("id"), seed) * (high - low) + low).alias("value"))


def generated(spark: SparkSession, n: int, make) -> DataFrame:
    """Any column generator: ``make`` gets the position's column."""
    return spark.range(n).select(F.col("id").alias("idx"), make(F.col("id")).alias("value"))


def outlier_bytes(spark: SparkSession, n: int, ratio: float, seed: int, majority: int = 69) -> DataFrame:
    """A majority byte with probability ``ratio``, else any; one 0 and one 255 planted."""
    value = F.when(uniform(F.col("id"), seed) < ratio, F.lit(majority)).otherwise(F.floor(uniform(F.col("id"), seed, 1) * 256))
    planted = F.when(F.col("id") == n // 3, 0).when(F.col("id") == 2 * n // 3, 255).otherwise(value)
    return spark.range(n).select(F.col("id").alias("idx"), planted.cast("short").alias("byte"))


def sampled_positions(points: DataFrame, ratio: float, idx: str = "idx", seed: int = 0) -> DataFrame:
    """Positions kept with probability ``ratio``: by hash, so the same on every run."""
    return points.select(idx).filter(uniform(F.col(idx), seed) < ratio)


def blobs(spark: SparkSession, n: int, features: int, centers: int, seed: int) -> DataFrame:
    """Points around centers in [-10, 10); the label is the row modulo the centers."""
    center = lambda j: uniform(F.col("id") % centers, seed + 1, j) * 20 - 10
    vector = F.array(*[center(j) + normal(F.col("id"), seed, j) for j in range(features)])
    return spark.range(n).select("id", (F.col("id") % centers).cast("int").alias("label"), vector.alias("vector"))


def circles(spark: SparkSession, n: int, factor: float, noise: float, seed: int) -> DataFrame:
    """An outer circle (label 0) and an inner one (label 1) with normal noise."""
    outer = n // 2
    inner = F.col("id") >= outer
    angle = F.when(inner, (F.col("id") - outer) / float(n - outer)).otherwise(F.col("id") / float(max(1, outer))) * (2 * np.pi)
    r = F.when(inner, F.lit(factor)).otherwise(1.0)
    vector = F.array(r * F.cos(angle) + normal(F.col("id"), seed) * noise, r * F.sin(angle) + normal(F.col("id"), seed, 1) * noise)
    return spark.range(n).select("id", inner.cast("int").alias("label"), vector.alias("vector"))


def limited(df: DataFrame, amount: int | None, order: Column | str = "idx") -> DataFrame:
    """The first ``amount`` rows; all without one."""
    return df if amount is None else df.orderBy(order).limit(amount)
