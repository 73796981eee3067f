"""Models that Spark fits, isolation forests, and selection of rows and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators.ranges import numbered
from ..session import kept
from .linear import assembled



def _labelled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    return assembled(df, features).withColumn("label", F.col(label).cast("double"))


def tree_classifier(df: DataFrame, features: list[str], label: str, max_depth: int = 30, impurity: str = "gini", seed: int = 0):
    """Split thresholds come from bins, not from every midpoint."""
    from pyspark.ml.classification import DecisionTreeClassifier

    return DecisionTreeClassifier(maxDepth=max_depth, impurity=impurity, maxBins=256, seed=seed).fit(_labelled(df, features, label))


def tree_regressor(df: DataFrame, features: list[str], target: str, max_depth: int = 30, seed: int = 0):
    from pyspark.ml.regression import DecisionTreeRegressor

    return DecisionTreeRegressor(maxDepth=max_depth, maxBins=256, seed=seed).fit(_labelled(df, features, target))


def forest_classifier(df: DataFrame, features: list[str], label: str, trees: int = 100, max_depth: int = 12, seed: int = 0):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=trees, maxDepth=max_depth, maxBins=256, seed=seed).fit(_labelled(df, features, label))


def forest_regressor(df: DataFrame, features: list[str], target: str, trees: int = 10, max_depth: int = 12, seed: int = 0):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=trees, maxDepth=max_depth, maxBins=256, seed=seed).fit(_labelled(df, features, target))


def linear_svc(df: DataFrame, features: list[str], label: str, c: float = 1.0, max_iter: int = 100):
    """Linear support vectors; C becomes a penalty of 1 / (C n)."""
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(1, df.count()))).fit(_labelled(df, features, label))


def predictions(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(assembled(df, features))


# ------------------------------------------------------- isolation forest
class IsolationForest:
    """Trees of random cuts, each on a sample of its own; scores near 1 are outliers."""

    def __init__(self, trees: int = 10, sample: int = 10, seed: int = 0):
        self.count, self.sample, self.seed = trees, sample, seed
        self.trees: list = []

    @staticmethod
    def path(n: int) -> float:
        """Mean depth of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        n = min(self.sample, len(x))
        return self.grown([x[rng.choice(len(x), n, replace=False)] for _ in range(self.count)])

    def grown(self, samples: list[np.ndarray]) -> IsolationForest:
        """A tree for each sample."""
        rng = np.random.default_rng(self.seed)
        limit = int(np.ceil(np.log2(max(2, self.sample))))

        def grow(rows: np.ndarray, depth: int):
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= limit or len(rows) < 2 or not len(free):
                return depth + self.path(len(rows))
            j = int(rng.choice(free))
            cut = rng.uniform(low[j], high[j])
            left = rows[:, j] < cut
            return j, cut, grow(rows[left], depth + 1) if left.any() else depth + 1, grow(rows[~left], depth + 1) if (~left).any() else depth + 1

        self.trees = [grow(x, 0) for x in samples if len(x)]
        self.norm = max(self.path(max(map(len, samples), default=0)), 1e-9)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if not isinstance(node, tuple):
                    depth[rows] += node
                    continue
                j, cut, left, right = node
                below = x[rows, j] < cut
                todo += [(left, rows[below]), (right, rows[~below])]
        return 2.0 ** (-depth / len(self.trees) / self.norm)


def isolation_forest(df: DataFrame, vector: str, trees: int = 10, sample: int = 10, seed: int = 0) -> IsolationForest:
    """Each tree has its own sample of all rows: those of least hash under its number.

    A task keeps the least of its rows for each tree, so trees x sample rows a task
    meet, and as many in all reach the driver.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            parts = [] if best is None else [best]
            with np.errstate(over="ignore"):
                for t in range(trees):
                    order = (h ^ np.uint64(t + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    order = ((order ^ (order >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                    at = np.argsort(order, kind="stable")[:sample]
                    parts.append(pa.table({"tree": np.full(len(at), t, np.int32), "o": order[at], "v": b.column("v").take(pa.array(at))}))
            every = pa.concat_tables(parts).sort_by([("tree", "ascending"), ("o", "ascending")])
            tree = every.column("tree").to_numpy()
            rank = np.arange(len(tree)) - np.searchsorted(tree, tree)
            best = every.filter(pa.array(rank < sample))
        if best is not None:
            yield from best.to_batches()

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).withColumn("h", F.xxhash64("v", F.lit(seed))).mapInArrow(least, "tree int, o long, v array<double>")
    rank = F.row_number().over(W.Window.partitionBy("tree").orderBy("o"))
    got = rows.withColumn("r", rank).filter(F.col("r") <= sample).orderBy("tree", "r").collect()
    return IsolationForest(trees, sample, seed).grown([np.array([r["v"] for r in got if r["tree"] == t]) for t in range(trees)])


def outlier_scores(df: DataFrame, vector: str, forest: IsolationForest, out: str = "score") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: shared.value.score(np.stack([np.asarray(v, float) for v in pdf[vector]])) if len(pdf) else np.zeros(0)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {out} double")


# --------------------------------------------------------------- selection
def train_test_split(df: DataFrame, key: str, test_size: float, seed: int | None = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly floor(n * test_size) rows of a seeded (or of the key's) order are test."""
    rows = df.withColumn("_o", F.xxhash64(F.col(key), F.lit(seed)) if seed is not None else F.lit(0))
    n = int(df.count() * test_size)
    rows = numbered(rows, ["_o", key], "_i")
    return rows.filter(F.col("_i") >= n).drop("_i", "_o"), rows.filter(F.col("_i") < n).drop("_i", "_o")


def folds(df: DataFrame, key: str, k: int = 3, seed: int | None = None) -> DataFrame:
    """A fold for each row: consecutive runs of the (seeded) order, the first n mod k
    one row longer.
    """
    order = ["_o", key] if seed is not None else [key]
    rows = df.withColumn("_o", F.xxhash64(F.col(key), F.lit(seed))) if seed is not None else df
    n = df.count()
    size, longer = divmod(n, k)
    rows = numbered(rows, order, "_i")
    edge = longer * (size + 1)
    fold = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (size + 1))).otherwise(longer + F.floor((F.col("_i") - edge) / max(1, size)))
    return rows.withColumn("fold", fold.cast("int")).drop("_i", "_o")


def cross_validate(df: DataFrame, key: str, fit: Callable, predict: Callable, score: Callable, k: int = 3, seed: int | None = None) -> list[tuple[float, float]]:
    """(train, test) scores of each fold; ``predict`` adds a column ``score`` reads."""
    rows = kept(folds(df, key, k, seed))
    out = []
    for i in range(k):
        train, test = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        model = fit(train)
        out.append((score(predict(model, train)), score(predict(model, test))))
    return out


def cross_predictions(df: DataFrame, key: str, fit: Callable, predict: Callable, k: int = 3, seed: int | None = None) -> DataFrame:
    """Every row with the prediction of the model that did not see its fold."""
    rows = kept(folds(df, key, k, seed))
    parts = [predict(fit(rows.filter(F.col("fold") != i)), rows.filter(F.col("fold") == i)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lossy_agreement(exact: DataFrame, lossy: DataFrame, key: str, label: str, predict: Callable) -> DataFrame:
    """Accuracy on lossy rows against the truth and against predictions on exact rows."""
    a = predict(exact).select(key, label, F.col("pred").alias("on_exact"))
    both = a.join(predict(lossy).select(key, F.col("pred").alias("on_lossy")), key)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return both.agg(
        share(F.col("on_exact") == F.col(label)).alias("exact_accuracy"), share(F.col("on_lossy") == F.col(label)).alias("lossy_accuracy"), share(F.col("on_lossy") == F.col("on_exact")).alias("agreement"),
    )
