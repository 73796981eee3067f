"""Clustering: KMeans, DBSCAN, assignment, and matching of clusters to labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalar import squared_distance
from ..operators.similarity import linked_within, marks_within
from ..operators.topk import dense_index
from ..session import kept


def linked(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links lead to.

    ``edges`` (a, b) has both directions, ``nodes`` (node) every node. A round
    hooks each root below the smallest root next to its tree, and halves paths
    until trees are flat.
    """
    tree = kept(nodes.select("node", F.col("node").alias("root")))
    while True:
        at = edges.join(tree.toDF("a", "ra"), "a").join(tree.toDF("b", "rb"), "b").filter("rb < ra")
        hooks = kept(at.groupBy("ra").agg(F.min("rb").alias("up")))
        if hooks.isEmpty():
            return tree
        moved = True
        while moved:  # pointers double their reach
            above = hooks.toDF("up", "above")
            step = kept(hooks.join(above, "up", "left").select("ra", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")))
            moved, hooks = not step.filter("moved").isEmpty(), step.select("ra", "up")
        tree = kept(tree.join(hooks.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))


def kmeans(df: DataFrame, vector: str, k: int = 2, max_iter: int = 100, seed: int = 0) -> np.ndarray:
    """Centroids by Spark's k-means; k below 2 is an error."""
    if k < 2:
        raise ValueError("k must be at least 2")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=k, maxIter=max_iter, seed=seed).fit(rows).clusterCenters())


def assign(df: DataFrame, vector: str, centroids: np.ndarray, out: str = "cluster") -> DataFrame:
    """The nearest centroid; ties go to the first. Centroids are literals: k is small."""
    d = [squared_distance(F.col(vector), F.array(*[F.lit(float(v)) for v in c])) for c in centroids]
    pairs = F.array(*[F.struct(x.alias("d"), F.lit(i).alias("i")) for i, x in enumerate(d)])
    return df.withColumn(out, F.array_min(pairs)["i"])


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(key, cluster) with -1 for noise, over all rows.

    Counts of neighbours give the cores; clusters are the components of links
    between cores, numbered by their smallest key. Another row belongs to the first
    cluster that has a core near it. Distances are taken three times, so that no
    pair leaves its task: pairs grow with the square of the rows.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    counts = marks_within(rows, rows, eps).groupBy("query_id").agg(F.sum("n").alias("n"))
    cores = kept(counts.filter(F.col("n") >= min_samples).select(F.col("query_id").alias("id")))
    flagged = kept(rows.join(cores.withColumn("core", F.lit(True)), "id", "left"))
    inner = flagged.filter("core").drop("core")
    labels = kept(linked_within(inner, eps))
    least = labels.groupBy("node").agg(F.min("label").alias("a"), F.collect_set("label").alias("labels"))
    links = least.select("a", F.explode("labels").alias("b")).filter("a <> b").distinct()
    # labels are rows of their component, so the least of those that are linked is its least key
    joined = linked(kept(links.union(links.select("b", "a"))), labels.select(F.col("label").alias("node")).distinct())
    roots = least.select("node", F.col("a").alias("label")).join(joined.withColumnRenamed("node", "label"), "label").select("node", "root")
    numbers = kept(dense_index(roots, "root", "cluster").select(F.col("node").alias("id"), "cluster"))
    outer = flagged.filter("core IS NULL")
    beside = marks_within(outer, inner.join(numbers, "id"), eps, "cluster").groupBy(F.col("query_id").alias("id")).agg(F.min("mark").cast("int").alias("cluster"))
    out = rows.select("id").join(numbers.unionByName(beside), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))


def dbscan_predict(queries: DataFrame, train: DataFrame, fitted: DataFrame, eps: float, key: str, vector: str) -> DataFrame:
    """Majority cluster within eps; noise votes -1, and so does an empty neighbourhood."""
    marked = train.select(key, vector).join(fitted.select(key, "cluster"), key)
    votes = marks_within(queries, marked, eps, "cluster", key, vector)
    best = votes.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("mark")).alias("c"))).alias("b"))
    out = queries.select(F.col(key).alias("query_id")).join(best, "query_id", "left")
    return out.select("query_id", F.coalesce(-F.col("b.c"), F.lit(-1)).cast("int").alias("cluster"))


def matched_accuracy(df: DataFrame, truth: str, cluster: str, last_wins: bool = False, classes: int | None = None) -> DataFrame:
    """Accuracy after each cluster takes its most frequent label.

    Ties go to the smallest label, or with ``last_wins`` to the largest.
    """
    counts = df.groupBy(cluster, truth).agg(F.count("*").alias("n"))
    tie: Column = F.col(truth).desc() if last_wins else F.col(truth).asc()
    top = counts.withColumn("r", F.row_number().over(W.Window.partitionBy(cluster).orderBy(F.desc("n"), tie)))
    return top.agg((F.sum(F.when(F.col("r") == 1, F.col("n"))) / F.sum("n")).alias("accuracy"))
