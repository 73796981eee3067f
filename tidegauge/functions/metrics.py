"""Metrics of classifiers, regressions and clusterings, as one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import running_total
from .scalar import divided


def accuracy(truth: Column, pred: Column) -> Column:
    return F.avg(F.when(truth == pred, 1.0).otherwise(0.0))


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1.0).otherwise(0.0))


def precision(truth: Column, pred: Column) -> Column:
    return divided(_count((truth == 1) & (pred == 1)), _count(pred == 1))


def recall(truth: Column, pred: Column) -> Column:
    return divided(_count((truth == 1) & (pred == 1)), _count(truth == 1))


def f_beta(truth: Column, pred: Column, beta: float = 1.0) -> Column:
    p, r, b = precision(truth, pred), recall(truth, pred), beta * beta
    return divided((1 + b) * p * r, b * p + r)


def mse(truth: Column, pred: Column) -> Column:
    return F.avg((truth - pred) * (truth - pred))


def mae(truth: Column, pred: Column) -> Column:
    return F.avg(F.abs(truth - pred))


def r2(truth: Column, pred: Column) -> Column:
    """1 - residual / total sum of squares, in one pass."""
    return 1 - divided(F.sum((truth - pred) * (truth - pred)), F.var_pop(truth) * F.count(truth))


def error_count(a: Column, b: Column) -> Column:
    return F.sum(F.when(a != b, 1).otherwise(0)).cast("long")


def mean_relative_error(a: Column, b: Column) -> Column:
    return F.avg(divided(a - b, a))


def mean_signed_difference(a: Column, b: Column) -> Column:
    return F.avg(a - b)


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """ROC AUC by mid-ranks.

    Scores are counted first, so that the running total is over distinct scores:
    ranges of scores are summed apart and only their totals meet in one task.
    """
    hits = F.sum(F.when(F.col(truth) == 1, 1).otherwise(0))
    counts = df.groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_n"), hits.alias("_hits"))
    ranged = running_total(counts, "_score", "_n", "_below")
    mid = F.col("_below") + (F.col("_n") + 1) / 2.0
    s = ranged.agg(F.sum(mid * F.col("_hits")).alias("r"), F.sum("_hits").alias("p"), F.sum("_n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return s.select(divided(F.col("r") - p * (p + 1) / 2.0, p * n).alias("auc"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return n.agg((-(F.sum(F.col("n") * F.log("n")) / total - F.log(total))).alias("entropy"))


def clustering_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Mutual information, homogeneity, completeness and V-measure.

    Labels are counted in one shuffle; all sums are over the contingency table.
    A single label has no entropy: its score divides by zero and is NaN.
    """
    cells = contingency(df.select(F.col(truth).alias("_t"), F.col(pred).alias("_p")), "_t", "_p")
    rows = cells.groupBy("_t").agg(F.sum("n").alias("_ra"))
    cols = cells.groupBy("_p").agg(F.sum("n").alias("_cb"))
    total = cells.agg(F.sum("n").alias("_total"))

    def h(counts: DataFrame, c: str, name: str) -> DataFrame:
        return counts.agg((F.log(F.sum(c).cast("double")) - F.sum(F.col(c) * F.log(c)) / F.sum(c)).alias(name))

    mi = cells.join(rows, "_t").join(cols, "_p").join(F.broadcast(total))
    mi = mi.agg(F.sum(F.col("n") / F.col("_total") * (F.log("n") + F.log("_total") - F.log("_ra") - F.log("_cb"))).alias("mutual_information"))
    out = mi.join(h(rows, "_ra", "ht")).join(h(cols, "_cb", "hp"))
    hom, com = F.try_divide(F.col("mutual_information"), F.col("ht")), F.try_divide(F.col("mutual_information"), F.col("hp"))
    nan = F.lit(float("nan"))
    out = out.select("mutual_information", F.coalesce(hom, nan).alias("homogeneity"), F.coalesce(com, nan).alias("completeness"))
    return out.withColumn("v_measure", F.coalesce(F.try_divide(2 * F.col("homogeneity") * F.col("completeness"), F.col("homogeneity") + F.col("completeness")), nan))
