"""Known values of distances, metrics, models and transforms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import metrics as m
from tidegauge.functions import scalar as s
from tidegauge.ml import bayes, cluster, dense, linear, models, store, svm
from tidegauge.operators import similarity, stats_index


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (s.euclidean, 5.19615242),
        (s.manhattan, 9.0),
        (lambda a, b: s.minkowski(a, b, 1), 9.0),
        (lambda a, b: s.minkowski(a, b, 2), 5.19615242),
        (lambda a, b: s.minkowski(a, b, 3), 4.32674871),
    ],
)
def test_distances(spark, f, want):
    assert value(spark, f(arr(1, 2, 3), arr(4, 5, 6))) == pytest.approx(want, abs=1e-8)


def test_more_distances(spark):
    with pytest.raises(ValueError, match="p must be at least 1"):
        s.minkowski(arr(1), arr(2), 0)
    assert value(spark, s.hamming(arr(1, 0, 0, 1, 0, 0, 1), arr(1, 1, 0, 0, 1, 0, 1))) == pytest.approx(0.42857142, abs=1e-7)
    data = [[64, 580, 29], [66, 570, 33], [68, 590, 37], [69, 660, 46], [73, 600, 55]]
    assert s.mahalanobis(np.array(data), np.mean(data, axis=0), [66, 640, 44]) == pytest.approx(5.33, abs=1e-2)
    assert value(spark, s.squared_distance(arr(1, 2, 3), arr(1, 2))) == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vector array<double>")


def test_neighbours(spark):
    line = vectors(spark, [[x] for x in range(1, 11)])
    assert {r.train_id for r in similarity.k_nearest(vectors(spark, [[2]]), line, 3).collect()} == {0, 1, 2}
    assert {r.train_id + 1 for r in similarity.within(vectors(spark, [[5]]), line, 3.0).collect()} == set(range(2, 9))
    plane = vectors(spark, [[x, x] for x in range(1, 6)])
    assert {r.train_id for r in similarity.k_nearest(vectors(spark, [[3, 3]]), plane, 3).collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="k must be"):
        similarity.k_nearest(line, line, 0)


def pairs(spark, a, b):
    return spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "t double, p double")


def test_metrics(spark):
    t, p = F.col("t"), F.col("p")
    assert pairs(spark, [0, 1, 2, 3], [0, 2, 1, 3]).agg(m.accuracy(t, p)).first()[0] == 0.5
    assert pairs(spark, [0, 1, 1, 0], [0, 0, 1, 1]).agg(m.precision(t, p)).first()[0] == 0.5
    assert pairs(spark, [0, 1, 1, 0, 1, 0], [0, 0, 1, 1, 1, 1]).agg(m.f_beta(t, p)).first()[0] == pytest.approx(0.57142857)
    assert m.auc(pairs(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), "t", "p").first()[0] == 0.75
    reg = pairs(spark, [3, -0.5, 2, 7], [2.5, 0, 2, 8])
    assert reg.agg(m.mse(t, p)).first()[0] == 0.375
    assert reg.agg(m.r2(t, p)).first()[0] == pytest.approx(0.948608137)
    v = pairs(spark, [0, 0, 1, 1, 2, 0, 4], [1, 0, 0, 0, 0, 1, 0])
    assert {(r.t, r.p): r.n for r in m.contingency(v, "t", "p").collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 2, (2, 0): 1, (4, 0): 1}
    assert m.entropy(v, "t").first()[0] == pytest.approx(1.2770, abs=1e-4)
    got = m.clustering_scores(v, "t", "p").first()
    assert [got.mutual_information, got.homogeneity, got.completeness, got.v_measure] == pytest.approx([0.3254, 0.2548, 0.5440, 0.3471], abs=1e-4)


def test_gaussian_bayes(spark):
    x = [(-1, -1, 1), (-2, -1, 1), (-3, -2, 1), (1, 1, 2), (2, 1, 2), (3, 2, 2)]
    df = spark.createDataFrame([(float(a), float(b), y) for a, b, y in x], "a double, b double, y int")
    rows = bayes.gaussian_parameters(df, "y", ["a", "b"]).orderBy("y").collect()
    assert [r.theta_a for r in rows] == [-2, 2]
    assert [r.theta_b for r in rows] == pytest.approx([-1.3333, 1.3333], abs=1e-4)
    assert [r.sigma_a for r in rows] == pytest.approx([0.6667] * 2, abs=1e-4)
    assert [r.prior for r in rows] == [0.5, 0.5]
    assert all(r.y == r.pred for r in bayes.gaussian(df, "y", ["a", "b"]).predict(df).collect())


def test_small_functions(spark):
    z = spark.range(-5, 6).select("id", s.zigzag(F.col("id")).alias("z")).withColumn("back", s.unzigzag(F.col("z")))
    assert all(r.id == r.back and r.z >= 0 for r in z.collect())
    assert [value(spark, s.bit_width(F.lit(x))) for x in (0, 1, 4, 255)] == [0, 1, 3, 8]
    assert value(spark, s.bits_to_int(F.lit("0011"))) == 12
    assert value(spark, s.sigmoid(F.lit(0.0))) == 0.5
    nan = F.lit(float("nan"))
    assert value(spark, s.second_wins_max(nan, F.lit(1.0))) == 1.0


def test_kernels(spark):
    a, b = arr(1, 2, 3), arr(4, 5, 6)
    assert value(spark, s.linear_kernel(a, b)) == 32
    assert value(spark, s.rbf_kernel(a, b, 0.055)) == pytest.approx(0.2265, abs=1e-3)
    assert value(spark, s.polynomial_kernel(a, b, 3.0, 0.5, 1.0)) == pytest.approx(4913.0)
    assert value(spark, s.sigmoid_kernel(a, b, 0.01, 0.1)) == pytest.approx(0.3969, abs=1e-3)


def test_dense():
    a = np.array([[4.0, 1, 2], [1, 5, 3], [2, 3, 6]])
    p, low, up = dense.lu(a)
    assert np.allclose(p @ a, low @ up)
    b = np.array([1.0, 2, 3])
    want = np.linalg.solve(a, b)
    for by in ("lu", "qr", "cholesky", "svd"):
        assert np.allclose(dense.solve(a, b, by), want)
    assert np.allclose(dense.biconjugate_gradient(a, b), want)
    values, vectors = dense.eigen(a)
    assert list(values) == sorted(values, reverse=True)
    assert np.allclose(a @ vectors, vectors * values)
    f, g = (lambda x: ((x - b) ** 2 * [1, 10, 100]).sum()), (lambda x: 2 * (x - b) * [1, 10, 100])
    for opt in (dense.gradient_descent, dense.lbfgs):
        assert np.allclose(opt(f, g, np.zeros(3)), b, atol=1e-5)


def test_linear(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2, 0.5] + 3
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    names = ["a", "b", "c"]
    for fit in (linear.least_squares(df, names, "y"), linear.ridge(df, names, "y", 1e-9), linear.lasso(df, names, "y", 1e-9)):
        assert np.allclose(fit.coefficients, [1, -2, 0.5], atol=1e-4)
        assert fit.intercept == pytest.approx(3, abs=1e-4)
    assert np.abs(linear.lasso(df, names, "y", 0.7).coefficients[2]) < 1e-9
    u, sv, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(linear.pca(df, names, 2)), np.abs(vt[:2].T), atol=1e-6)
    assert np.allclose(linear.truncated_svd(df, names, 2)[1], np.linalg.svd(x)[1][:2])


def test_models(spark):
    x = np.random.default_rng(0).normal(size=(400, 2))
    x[:5] += 12
    scores = models.IsolationForest(50, 128, 1).fit(x).score(x)
    assert scores[:5].min() > np.quantile(scores[5:], 0.98)
    df = spark.range(10).toDF("k")
    sizes = {r.fold: r.n for r in models.folds(df, "k", 3).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 4, 1: 3, 2: 3}
    train, test = models.train_test_split(df, "k", 0.25)
    assert (train.count(), test.count()) == (8, 2)
    with pytest.raises(ValueError, match="k must be"):
        cluster.kmeans(df, "k", 1)
    blob = vectors(spark, [[0, 0], [0, 0.1], [0.1, 0], [9, 9], [9, 9.1], [9.1, 9], [50, 50]])
    got = {r.id: r.cluster for r in cluster.dbscan(blob, "id", "vector", 0.5, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: -1}


def test_dbscan_beyond_a_driver_fit(spark, monkeypatch):
    """No row bound; a chain is one cluster, a border row takes the first cluster near it."""
    monkeypatch.setattr(cluster, "DBSCAN_ROWS", 10, raising=False)
    points = [[100 + 0.2 * i, 0] for i in range(40)] + [[0, 0], [0, 0.3], [0.3, 0], [0.7, 0], [1.1, 0], [1.4, 0], [1.1, 0.3], [50, 50]]
    got = {r.id: r.cluster for r in cluster.dbscan(vectors(spark, points), "id", "vector", 0.45, 4).collect()}
    x = np.array(points)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.45
    core, want, n = near.sum(axis=1) >= 4, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if want[i] < 0:
            stack, want[i] = [i], n
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & (want < 0)):
                    want[j] = n
                    if core[j]:
                        stack.append(j)
            n += 1
    assert [got[i] for i in sorted(got)] == want.tolist()


def test_votes(spark):
    near = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.6, 2), (1, 12, 0.7, 3), (1, 13, 0.8, 4)], "query_id long, train_id long, distance double, rank int")
    labels = spark.createDataFrame([(10, 7), (11, 8), (12, 8), (13, 7)], "train_id long, label int")
    assert similarity.vote(near, labels).first().pred == 8  # reached two votes first


@pytest.mark.parametrize(("lo", "hi"), [(0, 1000), (1, 999), (123, 987), (450, 451), (399, 801), (7, 7)])
def test_cover(lo, hi):
    nodes, edges = stats_index.cover(lo, hi, 3, base=10, fanout=4)
    got = [i for level, a, b in nodes for i in range(a * 10 * 4 ** (level - 1), (b + 1) * 10 * 4 ** (level - 1))] + [i for a, b in edges for i in range(a, b)]
    assert sorted(got) == list(range(lo, hi))


def shuffled(spark) -> int:
    """Bytes that this session shuffled."""
    return sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(True)))


def test_dbscan_shuffles_in_proportion(spark, monkeypatch):
    """Neither pairs nor blocks for each other block: four times the rows, about four times the bytes."""
    monkeypatch.setattr(similarity, "BLOCK", 100)
    r, took = np.random.default_rng(5), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of any size
    for n in (2000, 8000):
        points = np.stack([np.arange(n) % 10 * 50.0, *r.random((63, n)) / 16], axis=1)
        df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<float>").repartition(4).cache()
        df.count()
        before = shuffled(spark)
        got = {x.id: x.cluster for x in cluster.dbscan(df, "id", "vector", 0.5, 5).collect()}
        took.append(shuffled(spark) - before)
        assert got == {i: i % 10 for i in range(n)}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert took[1] < 6 * took[0]


@pytest.mark.parametrize("cell, tasks", [(7, 1), (10**6, 1), (40, 16)])
def test_cells_of_any_grid(spark, monkeypatch, cell, tasks):
    """Small and large cells give the pairs, clusters and neighbours of a plain search; a
    row without a vector has none, and what isn't a number hides no other row.
    """
    monkeypatch.setattr(similarity, "CELL", cell)
    real = similarity._grid
    monkeypatch.setattr(similarity, "_grid", lambda q, t, n: real(q, t, tasks))
    r = np.random.default_rng(8)
    points = np.r_[r.normal(size=(60, 2)) * 1.5, [[np.nan, 0.0]]]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(61, None)], "id long, vector array<double>")
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= 0.6
    assert {(x.query_id, x.train_id) for x in similarity.within(df, df, 0.6).collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(61), 99)
    for _ in range(61):
        label = np.where(core, np.where(near & core[None], label[None], 99).min(1), 99)
    number = {x: i for i, x in enumerate(sorted(set(label[core].tolist())))}
    beside = np.where(near & core[None], label[None], 99).min(1)
    assert len(number) > 2 and (beside[~core] < 99).any()
    assert {x.id: x.cluster for x in cluster.dbscan(df, "id", "vector", 0.6, 4).collect()} == {i: number.get(x, -1) for i, x in enumerate([*beside.tolist(), 99])}
    d = ((points[:60, None] - points[None, :60]) ** 2).sum(-1)
    want = {(i, j, k + 1) for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3].tolist())}
    assert {(x.query_id, x.train_id, x["rank"]) for x in similarity.k_nearest(df, df.filter("id < 60"), 3).collect() if x.query_id < 60} == want


def test_svm_decides_in_blocks():
    """What a task holds does not grow with its rows times the support rows."""
    r, held = np.random.default_rng(3), []

    def kernel(a, b):
        held.append(len(a) * len(b))
        return svm.rbf(0.5)(a, b)

    x, rows = r.normal(size=(3000, 4)), r.normal(size=(2000, 4))
    model = svm.Svm(kernel, x, r.normal(size=3000), 0.25)
    got = model.decision(rows)
    assert max(held) <= svm.CELLS and sum(held) == len(x) * len(rows)
    assert np.allclose(got, svm.rbf(0.5)(rows, x) @ model.weights + 0.25, atol=1e-9)
    assert model.decision(rows[:0]).shape == (0,)
    assert (svm.Svm(kernel, x, np.zeros(3000), 0.25).decision(rows) == 0.25).all()


def test_svm():
    r = np.random.default_rng(0)
    x = r.normal(size=(120, 2))
    y = np.where((x**2).sum(1) > 1.2, 1.0, -1.0)
    assert (np.sign(svm.fit_classifier(x, y, svm.rbf(1.0), c=10).decision(x)) == y).mean() > 0.95
    line = x @ [2.0, -1] + 0.5
    fit = svm.fit_regressor(x, line, svm.linear(), c=10, eps=0.1)
    assert np.abs(fit.decision(x) - line).max() < 0.15
    flat = svm.fit_classifier(x, np.sign(line), svm.linear(), c=100)
    assert (np.sign(flat.decision(x)) == np.sign(line)).mean() > 0.95


def test_models_as_text():
    m = linear.Linear(["a"], np.array([2.0]), 1.0)
    back = store.load(store.dump(m))
    assert back.features == ["a"] and back.intercept == 1.0
    x = np.random.default_rng(0).normal(size=(50, 3))
    forest = models.IsolationForest(5, 20).fit(x)
    assert np.allclose(store.load(store.dump(forest)).score(x), forest.score(x))
