"""Similarity search and distances over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar
from ..ml import cluster
from ..operators import similarity
from .registry import query, r6, vectors

D2 = "list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2))"
PAIRS = f"d AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, b.label AS label, sqrt({D2}) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id % 2 = 0 WHERE a.vec_id % 2 = 1)"


def _split(spark, d):
    v = vectors(spark, d)
    return v.filter("id % 2 = 1"), v.filter("id % 2 = 0")


@query("knn_1nn", f"WITH {PAIRS} SELECT query_id, train_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS r FROM d) WHERE r = 1")
def knn_1nn(spark, d):
    return similarity.k_nearest(*_split(spark, d), 1).select("query_id", "train_id", r6("distance").alias("distance"))


@query("knn_k3_vote", f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS r FROM d), v AS (SELECT query_id, label, count(*) AS w, max(r) AS last FROM n WHERE r <= 3 GROUP BY 1, 2) SELECT query_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, last) AS k FROM v) WHERE k = 1")
def knn_k3_vote(spark, d):
    q, t = _split(spark, d)
    return similarity.vote(similarity.k_nearest(q, t, 3), t.select(F.col("id").alias("train_id"), "label"))


@query("knn_accuracy", f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS r FROM d) SELECT round(avg(CASE WHEN n.label = e.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM n JOIN embeddings e ON e.vec_id = n.query_id WHERE r = 1")
def knn_accuracy(spark, d):
    q, t = _split(spark, d)
    near = similarity.k_nearest(q, t, 1).join(t.select(F.col("id").alias("train_id"), F.col("label").alias("pred")), "train_id")
    return near.join(q.select(F.col("id").alias("query_id"), "label"), "query_id").agg(r6(F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0))).alias("accuracy"))


@query("knn_weighted_mean", f"WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, train_id) AS r FROM d) SELECT query_id, round(sum(label / distance) / sum(1 / distance), 6) AS pred FROM n WHERE r <= 3 GROUP BY 1")
def knn_weighted_mean(spark, d):
    q, t = _split(spark, d)
    out = similarity.weighted_mean(similarity.k_nearest(q, t, 3), t.select(F.col("id").alias("train_id"), F.col("label").cast("double").alias("value")), weighted=True)
    return out.withColumn("pred", r6("pred"))


@query("radius_join", f"WITH {PAIRS} SELECT query_id, train_id, round(distance, 6) AS distance FROM d WHERE distance <= 1.1")
def radius_join(spark, d):
    return similarity.within(*_split(spark, d), 1.1).withColumn("distance", r6("distance"))


def _neighbours(spark, d):
    v = vectors(spark, d)
    return v.select("id", F.col("vector").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b")), "id")


N = "FROM (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
Z = "list_sum(list_transform(range(1, 65), lambda i: {}))"


@query("dist_euclidean", f"SELECT id, round(sqrt({Z.format('(a[i] - b[i]) ** 2')}), 6) AS distance {N}")
def dist_euclidean(spark, d):
    return _neighbours(spark, d).select("id", r6(scalar.euclidean(F.col("a"), F.col("b"))).alias("distance"))


@query("dist_squared", f"SELECT id, round({Z.format('(a[i] - b[i]) ** 2')}, 6) AS distance {N}")
def dist_squared(spark, d):
    return _neighbours(spark, d).select("id", r6(scalar.squared_distance(F.col("a"), F.col("b"))).alias("distance"))


@query("dist_manhattan", f"SELECT id, round({Z.format('abs(a[i] - b[i])')}, 6) AS distance {N}")
def dist_manhattan(spark, d):
    return _neighbours(spark, d).select("id", r6(scalar.manhattan(F.col("a"), F.col("b"))).alias("distance"))


@query("dist_minkowski", f"SELECT id, round({Z.format('abs(a[i] - b[i]) ** 3')} ** (1.0 / 3), 6) AS distance {N}")
def dist_minkowski(spark, d):
    return _neighbours(spark, d).select("id", r6(scalar.minkowski(F.col("a"), F.col("b"), 3)).alias("distance"))


@query("dist_hamming", f"SELECT id, round({Z.format('CASE WHEN floor(a[i] * 10) <> floor(b[i] * 10) THEN 1.0 ELSE 0.0 END')} / 64, 6) AS distance {N}")
def dist_hamming(spark, d):
    tenths = lambda c: F.transform(c, lambda x: F.floor(x.cast("double") * 10))
    return _neighbours(spark, d).select("id", r6(scalar.hamming(tenths("a"), tenths("b"))).alias("distance"))


DOT = Z.format("a[i] * b[i]")


@query("vector_norms", f"SELECT id, round({DOT}, 6) AS dot, round(sqrt({Z.format('a[i] * a[i]')}), 6) AS norm2, round({Z.format('abs(a[i])')}, 6) AS norm1, round(list_max(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 6) AS max_diff, CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS argmax {N}")
def vector_norms(spark, d):
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, d).select("id", r6(scalar.dot(a, b)).alias("dot"), r6(scalar.norm2(a)).alias("norm2"), r6(scalar.norm(a, 1.0)).alias("norm1"), r6(scalar.max_diff(a, b)).alias("max_diff"), scalar.argmax(a).alias("argmax"))


@query("kernels", f"SELECT id, round({DOT}, 6) AS linear, round(exp(-0.5 * {Z.format('(a[i] - b[i]) ** 2')}), 6) AS rbf, round((0.5 * {DOT} + 1) ** 2, 6) AS polynomial, round(tanh(0.1 * {DOT} + 0.5), 6) AS sigmoid, round(exp(-sqrt({Z.format('(a[i] - b[i]) ** 2')}) / 2 * 0.25), 6) AS shape {N}")
def kernels(spark, d):
    a, b = F.col("a"), F.col("b")
    k = {"linear": scalar.linear_kernel(a, b), "rbf": scalar.rbf_kernel(a, b, 0.5), "polynomial": scalar.polynomial_kernel(a, b, 2.0, 0.5, 1.0), "sigmoid": scalar.sigmoid_kernel(a, b, 0.1, 0.5), "shape": scalar.shape_kernel(a, b, 0.5)}
    return _neighbours(spark, d).select("id", *[r6(v).alias(n) for n, v in k.items()])


@query("vector_arithmetic", f"SELECT id, round({Z.format('a[i] + b[i]')}, 6) AS add, round({Z.format('(a[i] - b[i]) * 2')}, 6) AS sub, round({Z.format('a[i] * b[i]')}, 6) AS mul, round(list_max(list_transform(a, lambda x: exp(x - list_max(a)))) / list_sum(list_transform(a, lambda x: exp(x - list_max(a)))), 6) AS softmax {N}")
def vector_arithmetic(spark, d):
    a, b = F.col("a"), F.col("b")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return _neighbours(spark, d).select(
        "id", r6(total(scalar.elementwise(a, b, "add"))).alias("add"), r6(total(scalar.scaled(scalar.elementwise(a, b, "sub"), "mul", 2))).alias("sub"), r6(total(scalar.elementwise(a, b, "mul"))).alias("mul"),
        r6(F.array_max(scalar.softmax(F.transform(a, lambda x: x.cast("double"))))).alias("softmax"),
    )


@query("kmeans_assign", "WITH c AS (SELECT vec_id AS k, embedding AS e FROM embeddings WHERE vec_id < 5), d AS (SELECT v.vec_id AS id, c.k, list_sum(list_transform(range(1, 65), lambda i: (CAST(v.embedding[i] AS DOUBLE) - CAST(c.e[i] AS DOUBLE)) ** 2)) AS d2 FROM embeddings v, c) SELECT id, CAST(arg_min(k, d2) AS INTEGER) AS cluster FROM d GROUP BY id")
def kmeans_assign(spark, d):
    v = vectors(spark, d)
    centroids = np.array([r.vector for r in v.filter("id < 5").orderBy("id").collect()], float)
    return cluster.assign(v, "vector", centroids).select("id", "cluster")


@query("kmeans_fit")
def kmeans_fit(spark, d):
    v = vectors(spark, d)
    return cluster.assign(v, "vector", cluster.kmeans(v, "vector", 10, seed=1)).select("id", "label", "cluster")


EPS = 1.15


def _dbscan_sql(where: str) -> str:
    """Each gives f: id, cluster."""
    return (
        f"WITH RECURSIVE v AS (SELECT vec_id, embedding FROM embeddings WHERE {where}), near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON sqrt({D2}) <= {EPS}::DOUBLE), cores AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 5), "
        "links AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM cores) AND b IN (SELECT a FROM cores)), reach AS (SELECT a AS node, a AS root FROM cores UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b), "
        "roots AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), flat AS (SELECT r.node, min(least(r.root, s.root)) AS root FROM roots r JOIN reach e ON e.node = r.node JOIN roots s ON s.node = e.root GROUP BY 1), "
        "numbers AS (SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM flat), f AS (SELECT vec_id AS id, CAST(coalesce(min(n.cluster), -1) AS INTEGER) AS cluster FROM v LEFT JOIN near ON near.a = vec_id LEFT JOIN numbers n ON n.node = near.b GROUP BY 1)"
    )


@query("dbscan", f"{_dbscan_sql('true')} SELECT id, cluster FROM f")
def dbscan(spark, d):
    return cluster.dbscan(vectors(spark, d), "id", "vector", eps=EPS, min_samples=5)


@query("dbscan_predict", f"{_dbscan_sql('vec_id % 2 = 0')}, p AS (SELECT a.vec_id AS query_id, f.cluster, count(*) AS n FROM embeddings a JOIN v b ON sqrt({D2}) <= {EPS}::DOUBLE JOIN f ON f.id = b.vec_id WHERE a.vec_id % 2 = 1 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cluster) AS r FROM p) SELECT e.vec_id AS query_id, CAST(coalesce(w.cluster, -1) AS INTEGER) AS cluster FROM embeddings e LEFT JOIN w ON w.query_id = e.vec_id AND r = 1 WHERE e.vec_id % 2 = 1")
def dbscan_predict(spark, d):
    q, t = _split(spark, d)
    return cluster.dbscan_predict(q, t, cluster.dbscan(t, "id", "vector", eps=EPS), EPS, "id", "vector")
