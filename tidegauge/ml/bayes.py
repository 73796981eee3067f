"""Naive Bayes in closed form: one aggregation fits, one expression predicts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gaussian_parameters(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Prior, mean and population variance of each class, a row for each class."""
    total = df.agg(F.count("*").alias("total"))
    stats = [f(c).alias(f"{n}_{c}") for c in features for n, f in (("theta", F.avg), ("sigma", F.var_pop))]
    out = df.groupBy(label).agg(F.count("*").alias("n"), *stats).join(F.broadcast(total))
    return out.withColumn("prior", F.col("n") / F.col("total")).drop("total")


@dataclass
class NaiveBayes:
    """Classes with log priors and a log-likelihood expression for each."""

    classes: list
    scores: list[Column]

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """The class of greatest score; ties go to the first class."""
        best = F.greatest(*self.scores) if len(self.scores) > 1 else self.scores[0]
        pick = F.lit(None)
        for c, s in reversed(list(zip(self.classes, self.scores, strict=True))):
            pick = F.when(s == best, F.lit(c)).otherwise(pick)
        return df.withColumn(out, pick)


def gaussian(df: DataFrame, label: str, features: list[str], priors: list[float] | None = None) -> NaiveBayes:
    rows = gaussian_parameters(df, label, features).orderBy(label).collect()  # a row for each class
    scores = []
    for i, r in enumerate(rows):
        s = F.lit(float(np.log(priors[i] if priors else r["prior"])))
        for c in features:
            var, mean = r[f"sigma_{c}"], r[f"theta_{c}"]
            s = s - (F.col(c) - mean) * (F.col(c) - mean) / (2 * var) - float(np.log(2 * np.pi)) / 2 - float(np.log(var)) / 2
        scores.append(s)
    return NaiveBayes([r[label] for r in rows], scores)


def bernoulli(df: DataFrame, label: str, features: list[str], alpha: float = 1.0, threshold: float = 0.0) -> NaiveBayes:
    """Features are binarised; p = (count + alpha) / (rows of the class + 2 alpha)."""
    on = {c: F.when(F.col(c) > threshold, 1.0).otherwise(0.0) for c in features}
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(on[c]).alias(f"s_{c}") for c in features]).orderBy(label).collect()
    total = sum(r["n"] for r in rows)
    scores = []
    for r in rows:
        s = F.lit(float(np.log(r["n"] / total)))
        for c in features:
            p = (r[f"s_{c}"] + alpha) / (r["n"] + 2 * alpha)
            s = s + F.when(on[c] == 1, float(np.log(p))).otherwise(float(np.log(1 - p)))
        scores.append(s)
    return NaiveBayes([r[label] for r in rows], scores)


def multinomial(df: DataFrame, label: str, features: list[str], alpha: float = 1.0) -> NaiveBayes:
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in features]).orderBy(label).collect()
    total = sum(r["n"] for r in rows)
    scores = []
    for r in rows:
        mass = sum(r[f"s_{c}"] for c in features) + alpha * len(features)
        s = F.lit(float(np.log(r["n"] / total)))
        for c in features:
            s = s + F.col(c) * float(np.log((r[f"s_{c}"] + alpha) / mass))
        scores.append(s)
    return NaiveBayes([r[label] for r in rows], scores)


def categorical(df: DataFrame, label: str, features: list[str], alpha: float = 1.0) -> NaiveBayes:
    """Each feature's categories are 0 to its greatest; unseen ones count alpha."""
    tops = df.agg(*[F.max(c).alias(c) for c in features]).first()
    counts = [F.sum(F.when(F.col(c) == v, 1).otherwise(0)).alias(f"s_{c}_{v}") for c in features for v in range(int(tops[c]) + 1)]
    rows = df.groupBy(label).agg(F.count("*").alias("n"), *counts).orderBy(label).collect()
    total = sum(r["n"] for r in rows)
    scores = []
    for r in rows:
        s = F.lit(float(np.log(r["n"] / total)))
        for c in features:
            k = int(tops[c]) + 1
            table = F.array(*[F.lit(float(np.log((r[f"s_{c}_{v}"] + alpha) / (r["n"] + alpha * k)))) for v in range(k)])
            s = s + F.try_element_at(table, F.col(c).cast("int") + 1)
        scores.append(s)
    return NaiveBayes([r[label] for r in rows], scores)
