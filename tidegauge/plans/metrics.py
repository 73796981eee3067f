"""Metrics, closed-form models and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as m
from ..ml import bayes, cluster, linear, models, svm
from .registry import points, query, r6, vectors

P = "(SELECT event_id AS idx, user_id AS signal_id, event_type AS kind, value FROM events) p"
# derived labels: truth by value, prediction by signal, score from the value's last digits
L = f"(SELECT idx, CASE WHEN value > 20 THEN 1 ELSE 0 END AS truth, CASE WHEN (signal_id + idx) % 3 = 0 THEN 1 ELSE 0 END AS pred, (signal_id * 7 + idx) % 50 AS score, kind, value, signal_id FROM {P}) l"


def labelled(spark, d):
    p = points(spark, d)
    return p.select(
        "idx", F.when(F.col("value") > 20, 1).otherwise(0).alias("truth"), F.when((F.col("signal_id") + F.col("idx")) % 3 == 0, 1).otherwise(0).alias("pred"),
        ((F.col("signal_id") * 7 + F.col("idx")) % 50).alias("score"), "kind", "value", "signal_id",
    )


@query("accuracy", f"SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(sum(CASE WHEN truth <> pred THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM {L}")
def accuracy(spark, d):
    t, p = F.col("truth"), F.col("pred")
    return labelled(spark, d).agg(r6(m.accuracy(t, p)).alias("accuracy"), m.error_count(t, p).alias("errors"))


@query("prf", f"WITH c AS (SELECT sum(CASE WHEN truth = 1 AND pred = 1 THEN 1.0 ELSE 0.0 END) AS tp, sum(pred) AS pp, sum(truth) AS tt FROM {L}) SELECT round(tp / pp, 6) AS precision, round(tp / tt, 6) AS recall, round(2 * (tp / pp) * (tp / tt) / (tp / pp + tp / tt), 6) AS f1 FROM c")
def prf(spark, d):
    t, p = F.col("truth"), F.col("pred")
    return labelled(spark, d).agg(r6(m.precision(t, p)).alias("precision"), r6(m.recall(t, p)).alias("recall"), r6(m.f_beta(t, p)).alias("f1"))


@query("auc", f"WITH r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM {L}), s AS (SELECT sum(CASE WHEN truth = 1 THEN mid ELSE 0 END) AS rs, sum(truth) AS p, count(*) - sum(truth) AS n FROM r) SELECT round((rs - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM s")
def auc(spark, d):
    return m.auc(labelled(spark, d), "truth", "score").select(r6("auc").alias("auc"))


@query("r2_mse_mae", f"SELECT round(avg((value - score) ** 2), 4) AS mse, round(avg(abs(value - score)), 6) AS mae, round(1 - sum((value - score) ** 2) / (var_pop(value) * count(value)), 6) AS r2 FROM {L}")
def r2_mse_mae(spark, d):
    t, p = F.col("value"), F.col("score").cast("double")
    return labelled(spark, d).agg(F.round(m.mse(t, p), 4).alias("mse"), r6(m.mae(t, p)).alias("mae"), r6(m.r2(t, p)).alias("r2"))


@query("vector_errors", f"SELECT round(avg(value - (score + 1)), 6) AS signed, round(avg((value - (score + 1)) / value), 4) AS relative FROM {L}")
def vector_errors(spark, d):
    t, p = F.col("value"), F.col("score") + 1.0
    return labelled(spark, d).agg(r6(m.mean_signed_difference(t, p)).alias("signed"), F.round(m.mean_relative_error(t, p), 4).alias("relative"))


@query("contingency", f"SELECT kind, score // 10 AS bucket, count(*) AS n FROM {L} GROUP BY 1, 2")
def contingency(spark, d):
    return m.contingency(labelled(spark, d).withColumn("bucket", F.floor(F.col("score") / 10)), "kind", "bucket")


@query("entropy", f"WITH c AS (SELECT count(*) AS n FROM {L} GROUP BY kind), t AS (SELECT sum(n) AS t FROM c) SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM c, t")
def entropy(spark, d):
    return m.entropy(labelled(spark, d), "kind").select(r6("entropy").alias("entropy"))


@query(
    "hcv",
    f"WITH c AS (SELECT kind, CAST(floor(value / 20) AS BIGINT) AS b, count(*) AS n FROM {L} GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), r AS (SELECT kind, sum(n) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), mi AS (SELECT sum(n / t * ln(n * t / (ra * cb))) AS mi FROM c JOIN r USING (kind) JOIN k USING (b), t), h AS (SELECT (SELECT -sum(ra / t * ln(ra / t)) FROM r, t) AS ht, (SELECT -sum(cb / t * ln(cb / t)) FROM k, t) AS hp) SELECT round(mi, 6) AS mutual_information, round(mi / ht, 6) AS homogeneity, round(mi / hp, 6) AS completeness, round(2 * (mi / ht) * (mi / hp) / (mi / ht + mi / hp), 6) AS v_measure FROM mi, h",
)
def hcv(spark, d):
    rows = labelled(spark, d).withColumn("b", F.floor(F.col("value") / 20))
    out = m.clustering_scores(rows, "kind", "b")
    return out.select([r6(c).alias(c) for c in out.columns])


@query("cluster_match", f"WITH c AS (SELECT score // 10 AS k, pred + 1 AS t, count(*) AS n FROM {L} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, t) AS r FROM c) SELECT round(sum(CASE WHEN r = 1 THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM r")
def cluster_match(spark, d):
    rows = labelled(spark, d).select((F.col("pred") + 1).alias("t"), F.floor(F.col("score") / 10).alias("k"))
    return cluster.matched_accuracy(rows, "t", "k").select(r6("accuracy").alias("accuracy"))


@query("label_errors", f"WITH b AS (SELECT idx // 100 AS node, truth, pred FROM {L}), e AS (SELECT min(node) AS lo, max(node) AS hi FROM b) SELECT round(avg(CASE WHEN node < lo + 10 THEN CASE WHEN truth <> pred THEN 1.0 ELSE 0.0 END END), 6) AS \"first\", round(avg(CASE WHEN node > hi - 10 THEN CASE WHEN truth <> pred THEN 1.0 ELSE 0.0 END END), 6) AS \"last\", round(avg(CASE WHEN truth <> pred THEN 1.0 ELSE 0.0 END), 6) AS \"all\" FROM b, e")
def label_errors(spark, d):
    from ..operators.aggregate import label_errors as f

    rows = labelled(spark, d).select(F.floor(F.col("idx") / 100).alias("node"), F.col("truth").alias("exact"), F.col("pred").alias("lossy"))
    out = f(rows)
    return out.select([r6(c).alias(c) for c in out.columns])


GNB = "SELECT event_type AS kind, count(*) AS n, round(avg(value), 6) AS theta_value, round(var_pop(value), 4) AS sigma_value, round(avg(user_id), 6) AS theta_signal_id, round(var_pop(user_id), 4) AS sigma_signal_id, round(count(*) / (SELECT count(*) FROM events), 6) AS prior FROM events GROUP BY 1"


@query("gnb_params", GNB)
def gnb_params(spark, d):
    out = bayes.gaussian_parameters(points(spark, d), "kind", ["value", "signal_id"])
    return out.select("kind", "n", *[(F.round(c, 4) if c.startswith("sigma") else r6(c)).alias(c) for c in out.columns if c not in ("kind", "n")])


CLASSES = "SELECT {by}kind AS c, count(*) AS n, avg(value) AS m1, var_pop(value) AS v1, avg(signal_id) AS m2, var_pop(signal_id) AS v2 FROM {rows} GROUP BY ALL"
LIKELY = "ln(k.n * 1.0::DOUBLE / {total}) - (e.value - k.m1) ** 2 / (2 * k.v1) - ln(2 * pi()) / 2 - ln(k.v1) / 2 - (e.signal_id - k.m2) ** 2 / (2 * k.v2) - ln(2 * pi()) / 2 - ln(k.v2) / 2"


@query("gnb_predict", f"WITH k AS ({CLASSES.format(by='', rows=P)}), s AS (SELECT e.idx, e.kind, k.c, {LIKELY.format(total='(SELECT sum(n) FROM k)')} AS s FROM {P.removesuffix(' p')} e, k) SELECT idx, kind, c AS pred FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s DESC, c) AS r FROM s) WHERE r = 1")
def gnb_predict(spark, d):
    p = points(spark, d)
    return bayes.gaussian(p, "kind", ["value", "signal_id"]).predict(p).select("idx", "kind", "pred")


@query(
    "bernoulli_nb",
    f"WITH b AS (SELECT idx, truth, CASE WHEN score > 25 THEN 1.0 ELSE 0.0 END AS f1, CASE WHEN pred > 0 THEN 1.0 ELSE 0.0 END AS f2 FROM {L}), k AS (SELECT truth AS c, count(*) AS n, (sum(f1) + 1) / (count(*) + 2) AS p1, (sum(f2) + 1) / (count(*) + 2) AS p2 FROM b GROUP BY 1), s AS (SELECT idx, c, ln(n / (SELECT sum(n) FROM k)) + CASE WHEN f1 = 1 THEN ln(p1) ELSE ln(1 - p1) END + CASE WHEN f2 = 1 THEN ln(p2) ELSE ln(1 - p2) END AS s FROM b, k) SELECT idx, CAST(c AS INTEGER) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s DESC, c) AS r FROM s) WHERE r = 1",
)
def bernoulli_nb(spark, d):
    rows = labelled(spark, d).select("idx", "truth", (F.col("score") - 25).alias("f1"), F.col("pred").alias("f2"))
    return bayes.bernoulli(rows, "truth", ["f1", "f2"]).predict(rows).select("idx", "pred")


@query(
    "multinomial_nb",
    f"WITH b AS (SELECT idx, truth, score AS f1, signal_id AS f2 FROM {L}), k AS (SELECT truth AS c, count(*) AS n, sum(f1) + 1 AS s1, sum(f2) + 1 AS s2 FROM b GROUP BY 1), s AS (SELECT idx, c, ln(n / (SELECT sum(n) FROM k)) + f1 * ln(s1 / (s1 + s2)) + f2 * ln(s2 / (s1 + s2)) AS s FROM b, k) SELECT idx, CAST(c AS INTEGER) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s DESC, c) AS r FROM s) WHERE r = 1",
)
def multinomial_nb(spark, d):
    rows = labelled(spark, d).select("idx", "truth", F.col("score").alias("f1"), F.col("signal_id").alias("f2"))
    return bayes.multinomial(rows, "truth", ["f1", "f2"]).predict(rows).select("idx", "pred")


@query(
    "categorical_nb",
    f"WITH b AS (SELECT idx, truth, score // 10 AS f FROM {L}), w AS (SELECT max(f) + 1 AS w FROM b), k AS (SELECT truth AS c, count(*) AS n FROM b GROUP BY 1), q AS (SELECT truth AS c, f, count(*) AS m FROM b GROUP BY 1, 2), s AS (SELECT idx, k.c, ln(n / (SELECT sum(n) FROM k)) + ln((coalesce(m, 0) + 1) / (n + w)) AS s FROM b CROSS JOIN k CROSS JOIN w LEFT JOIN q ON q.c = k.c AND q.f = b.f) SELECT idx, CAST(c AS INTEGER) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s DESC, c) AS r FROM s) WHERE r = 1",
)
def categorical_nb(spark, d):
    rows = labelled(spark, d).select("idx", "truth", F.floor(F.col("score") / 10).alias("f"))
    return bayes.categorical(rows, "truth", ["f"]).predict(rows).select("idx", "pred")


@query("linear_regression", f"SELECT round(regr_slope(value, score), 6) AS slope, round(regr_intercept(value, score), 6) AS intercept FROM {L}")
def linear_regression(spark, d):
    fit = linear.least_squares(labelled(spark, d), ["score"], "value")
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 6), round(fit.intercept, 6))], "slope double, intercept double")


# centred sums of two features and the target; the standardised Gram matrix has n on its diagonal
SUMS = f"m AS (SELECT count(*) AS n, avg(score) AS ma, avg(signal_id) AS mb, avg(value) AS my FROM {L}), c AS (SELECT any_value(n) AS n, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((score - ma) ** 2) AS aa, sum((signal_id - mb) ** 2) AS bb, sum((score - ma) * (signal_id - mb)) AS ab, sum((score - ma) * (value - my)) AS ay, sum((signal_id - mb) * (value - my)) AS byy FROM {L}, m)"


@query(
    "ridge",
    f"WITH {SUMS}, z AS (SELECT *, sqrt(aa / n) AS sa, sqrt(bb / n) AS sb FROM c), g AS (SELECT *, n + 1.0 AS d, ab / (sa * sb) AS o, ay / sa AS p, byy / sb AS q FROM z), w AS (SELECT *, (p * d - q * o) / (d * d - o * o) / sa AS wa, (q * d - p * o) / (d * d - o * o) / sb AS wb FROM g) SELECT round(wa, 6) AS score, round(wb, 6) AS signal_id, round(my - ma * wa - mb * wb, 4) AS intercept FROM w",
)
def ridge(spark, d):
    f = linear.ridge(labelled(spark, d), ["score", "signal_id"], "value")
    return spark.createDataFrame([(round(float(f.coefficients[0]), 6), round(float(f.coefficients[1]), 6), round(f.intercept, 4))], "score double, signal_id double, intercept double")


SOFT = "sign(p) * greatest(abs(p) - n * 0.1 * {l1}, 0) / (n + n * 0.1 * (1 - {l1})) / sa"


@query(
    "lasso_elastic_net",
    f"WITH {SUMS}, z AS (SELECT *, sqrt(aa / n) AS sa, ay / sqrt(aa / n) AS p FROM c), w AS (SELECT 'lasso' AS model, {SOFT.format(l1='1.0')} AS w, ma, my FROM z UNION ALL SELECT 'elastic_net', {SOFT.format(l1='0.5')}, ma, my FROM z) SELECT model, round(w, 6) AS coefficient, round(my - ma * w, 4) AS intercept FROM w",
)
def lasso_elastic_net(spark, d):
    """One feature: soft thresholding in closed form."""
    rows = labelled(spark, d)
    fits = {"lasso": linear.lasso(rows, ["score"], "value", 0.1), "elastic_net": linear.elastic_net(rows, ["score"], "value", 0.1)}
    return spark.createDataFrame([(n, round(float(f.coefficients[0]), 6), round(f.intercept, 4)) for n, f in fits.items()], "model string, coefficient double, intercept double")


@query("ridge_lasso")
def ridge_lasso(spark, d):
    rows = labelled(spark, d)
    fits = {"ridge": linear.ridge(rows, ["score", "signal_id"], "value"), "lasso": linear.lasso(rows, ["score", "signal_id"], "value", 0.1), "elastic_net": linear.elastic_net(rows, ["score", "signal_id"], "value", 0.1)}
    return spark.createDataFrame([(n, [float(c) for c in f.coefficients], f.intercept) for n, f in fits.items()], "model string, coefficients array<double>, intercept double")


@query("logistic_regression")
def logistic_regression(spark, d):
    rows = labelled(spark, d)
    return models.predictions(linear.logistic(rows, ["score", "signal_id"], "truth"), rows, ["score", "signal_id"]).select("idx", F.col("prediction").cast("int").alias("pred"))


NAMES = [f"x{i}" for i in range(64)]


def _dims(v, names=NAMES):
    return v.select("id", "label", *[F.col("vector")[int(n[1:])].cast("double").alias(n) for n in names])


@query("decision_tree")
def decision_tree(spark, d):
    rows, names = _dims(vectors(spark, d)), NAMES
    return models.predictions(models.tree_classifier(rows, names, "label", 8), rows, names).select("id", F.col("prediction").cast("int").alias("pred"))


@query("random_forest")
def random_forest(spark, d):
    rows, names = _dims(vectors(spark, d)), NAMES
    return models.predictions(models.forest_classifier(rows, names, "label", 10, 6), rows, names).select("id", F.col("prediction").cast("int").alias("pred"))


@query("linear_svc")
def linear_svc(spark, d):
    rows, names = _dims(vectors(spark, d).withColumn("label", (F.col("label") % 2))), NAMES
    return models.predictions(models.linear_svc(rows, names, "label"), rows, names).select("id", F.col("prediction").cast("int").alias("pred"))


@query("kernel_svc")
def kernel_svc(spark, d):
    v = vectors(spark, d).withColumn("label", (F.col("label") % 2))
    return svm.decide(v.select("id", "vector"), "vector", svm.svc(v, "vector", "label", svm.rbf(0.5))).select("id", "decision")


@query("pca")
def pca(spark, d):
    names = NAMES
    rows = _dims(vectors(spark, d))
    mom = linear.moments(rows, names)
    return rows.select("id", linear.project(names, linear.pca(rows, names), mom.mean).alias("components"))


@query("truncated_svd")
def truncated_svd(spark, d):
    names = NAMES
    rows = _dims(vectors(spark, d))
    return rows.select("id", linear.project(names, linear.truncated_svd(rows, names)[0]).alias("components"))


# the leading eigenvector of a symmetric 2 x 2 matrix (p, q; q, r), its larger part positive
PLANE = "SELECT *, (p + r) / 2 + sqrt(((p - r) / 2) ** 2 + q * q) AS top FROM {}"
AXIS = "SELECT *, CASE WHEN abs(ux) >= abs(uy) THEN sign(ux) ELSE sign(uy) END / sqrt(ux * ux + uy * uy) AS k FROM (SELECT *, q AS ux, top - p AS uy FROM {})"
XY = "(SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(
    "pca_plane",
    f"WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS p, covar_samp(x, y) AS q, var_samp(y) AS r FROM {XY}), a AS ({PLANE.format('m')}), b AS ({AXIS.format('a')}) SELECT id, round((x - mx) * ux * k + (y - my) * uy * k, 6) AS component FROM {XY} d, b",
)
def pca_plane(spark, d):
    """The leading component of two columns, which has a closed form."""
    rows, names = _dims(vectors(spark, d)), NAMES[:2]
    return rows.select("id", F.round(linear.project(names, linear.pca(rows, names, 1), linear.moments(rows, names).mean)[0], 6).alias("component"))


@query(
    "svd_plane",
    f"WITH m AS (SELECT sum(x * x) AS p, sum(x * y) AS q, sum(y * y) AS r FROM {XY}), a AS ({PLANE.format('m')}), b AS ({AXIS.format('a')}) SELECT id, round(x * ux * k + y * uy * k, 6) AS component FROM {XY} d, b",
)
def svd_plane(spark, d):
    rows, names = _dims(vectors(spark, d)), NAMES[:2]
    return rows.select("id", F.round(linear.project(names, linear.truncated_svd(rows, names, 1)[0])[0], 6).alias("component"))


@query("tree_stump", f"WITH v AS (SELECT CAST(score AS DOUBLE) AS x, count(*) AS n, sum(value) AS s FROM {L} GROUP BY 1), c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER (ORDER BY x) AS ls, (SELECT sum(n) FROM v) AS n, (SELECT sum(s) FROM v) AS s FROM v), b AS (SELECT (x + nx) / 2 AS cut, ls / ln AS low, (s - ls) / (n - ln) AS high FROM c WHERE nx IS NOT NULL ORDER BY ls * ls / ln + (s - ls) ** 2 / (n - ln) DESC, x LIMIT 1) SELECT idx, round(CASE WHEN score <= cut THEN low ELSE high END, 6) AS pred FROM {L}, b")
def tree_stump(spark, d):
    """A regression tree of one split."""
    rows = labelled(spark, d).withColumn("score", F.col("score").cast("double"))
    return models.predictions(models.tree_regressor(rows, ["score"], "value", 1), rows, ["score"]).select("idx", r6("prediction").alias("pred"))


@query("isolation_forest")
def isolation_forest(spark, d):
    v = vectors(spark, d).select("id", F.transform("vector", lambda x: F.floor((x.cast("double") + 10) * 100000).cast("double")).alias("vector"))
    return models.outlier_scores(v, "vector", models.isolation_forest(v, "vector")).select("id", "score")


@query("kfold_sizes", "SELECT CAST(f - 1 AS INTEGER) AS fold, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, ntile(3) OVER (ORDER BY event_id) AS f FROM events) GROUP BY 1")
def kfold_sizes(spark, d):
    return models.folds(points(spark, d).select("idx"), "idx", 3).groupBy("fold").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("train_test_split", "SELECT count(*) - CAST(floor(count(*) * 0.25) AS BIGINT) AS train, CAST(floor(count(*) * 0.25) AS BIGINT) AS test FROM events")
def train_test_split(spark, d):
    train, test = models.train_test_split(points(spark, d).select("idx"), "idx", 0.25)
    return train.agg(F.count("*").alias("train")).join(F.broadcast(test.agg(F.count("*").alias("test"))))


FOLDS = f"f AS (SELECT *, CAST(ntile(3) OVER (ORDER BY idx) - 1 AS INTEGER) AS fold FROM {P})"


@query("cross_validation", f"WITH {FOLDS}, o AS (SELECT g.x AS out, f.* FROM f, (SELECT unnest(range(3)) AS x) g WHERE f.fold <> g.x), k AS ({CLASSES.format(by='out, ', rows='o')}), s AS (SELECT e.idx, e.fold, k.c, {LIKELY.format(total='(SELECT sum(n) FROM k k2 WHERE k2.out = e.fold)')} AS s FROM f e JOIN k ON k.out = e.fold) SELECT idx, fold, c AS pred FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY s DESC, c) AS r FROM s) WHERE r = 1")
def cross_validation(spark, d):
    rows = points(spark, d).select("idx", "kind", "value", "signal_id")
    return models.cross_predictions(rows, "idx", lambda t: bayes.gaussian(t, "kind", ["value", "signal_id"]), lambda model, t: model.predict(t)).select("idx", "fold", "pred")
