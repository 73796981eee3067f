"""Similarity search: nearest neighbours and radius, in cells.

Queries and training rows are dealt to a grid of cells, a task each. A cell holds
its queries, a bounded number, and training rows stream past them; so a row is sent
to one line of the grid, and not to every block of the other side. Distances are
taken by matrix products, and exactly for the pairs that matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

BLOCK = 2048  # training rows that meet ROWS queries at once
ROWS = 256
CELL = 1 << 16  # queries of a cell
_FOUND: dict[int, list[int]] = {}


def _grid(queries: int, train: int, tasks: int) -> tuple[int, int]:
    """Parts of queries and of training rows, about ``tasks`` cells: queries are sent
    once for each part of the others, and the other way round.
    """
    least = max(1, -(-queries // CELL))
    cost = lambda g: queries * -(-tasks // g) + train * g
    g = min(range(least, max(least, tasks) + 1), key=cost)
    return g, -(-tasks // g)


def _routes(spark: SparkSession, cells: int) -> list[int]:
    """A number for each cell, each of which a shuffle deals to a partition of its own."""
    if cells not in _FOUND:
        ids = spark.range(cells * 64).select(F.col("id").cast("int").alias("id"))
        found = dict(ids.groupBy(F.pmod(F.hash("id"), F.lit(cells)).alias("at")).agg(F.min("id")).collect())
        _FOUND[cells] = [found[i] for i in range(cells)] if len(found) == cells else list(range(cells))
    return _FOUND[cells]


def near(queries: np.ndarray, train: np.ndarray, limit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) of least distance, with their exact squared distances.

    One product gives all distances up to its rounding; ``limit`` turns them into
    the greatest that matters (by row or for all), and pairs up to that and the
    rounding are taken again without cancellation.
    """
    a, b = (queries * queries).sum(axis=1), (train * train).sum(axis=1)
    rough = a[:, None] + b[None] - 2 * (queries @ train.T)
    slack = 1e-11 * (np.fmax.reduce(a, initial=0) + np.fmax.reduce(b, initial=0) + 1) * queries.shape[1]
    i, j = np.nonzero(rough <= limit(rough) + slack)
    return i, j, ((queries[i] - train[j]) ** 2).sum(axis=1)


class Cell:
    """What a task does: it is given its queries, then blocks of training rows."""

    def start(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        self.keys, self.vectors = keys, vectors

    def block(self, keys: np.ndarray, vectors: np.ndarray, marks: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns of result rows; ``marks`` are the numbers that training rows came with."""
        return iter(())

    def end(self) -> Iterator[tuple[np.ndarray, ...]]:
        return iter(())


def in_cells(queries: DataFrame, train: DataFrame, make: Callable[[], Cell], schema: str, key: str = "id", vector: str = "vector", mark: str | None = None) -> DataFrame:
    """Rows of all cells: a query may have some from each cell that it is in. Rows
    without a vector are near nothing.
    """
    spark = queries.sparkSession
    queries, train = (d.filter(F.col(vector).isNotNull()) for d in (queries, train))
    single = all(isinstance(d.schema[vector].dataType, T.ArrayType) and isinstance(d.schema[vector].dataType.elementType, T.FloatType) for d in (queries, train))
    n = queries.count(), train.count()
    if not all(n):
        return spark.createDataFrame([], schema)
    g, p = _grid(*n, max(8, spark.sparkContext.defaultParallelism))
    route = F.array(*[F.lit(r) for r in _routes(spark, g * p)])

    def rows(df: DataFrame, kind: int, at, mark) -> DataFrame:
        k, v = F.col(key).cast("long").alias("k"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")
        return df.select(F.explode(at(F.xxhash64(F.col(key).cast("long")))).alias("cell"), F.lit(kind).alias("kind"), k, v, mark.cast("long").alias("mark"))

    every = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    of = lambda i: F.element_at(route, (i + 1).cast("int"))
    q = rows(queries, 0, lambda h: F.transform(every(p), lambda j: of(F.pmod(h, F.lit(g)) * p + j)), F.lit(0))
    t = rows(train, 1, lambda h: F.transform(every(g), lambda i: of(i * p + F.pmod(h, F.lit(p)))), F.col(mark) if mark else F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]
        batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        now: Any = None
        work: Cell | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            cell, kind, k, mark = (b.column(c).to_numpy() for c in ("cell", "kind", "k", "mark"))
            if not len(cell):
                continue
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1]), True])
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if cell[x] != now:
                    if work is not None:
                        yield from map(batch, work.end())
                    now, work, held = cell[x], None, []
                v = b.column("v").slice(x, y - x).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(y - x, -1)
                if kind[x] == 0:
                    held.append((k[x:y], v))
                    continue
                if work is None:
                    if not held:
                        continue
                    work = make()
                    work.start(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held = []
                for at in range(0, y - x, BLOCK):
                    yield from map(batch, work.block(k[x:y][at : at + BLOCK], v[at : at + BLOCK], mark[x:y][at : at + BLOCK]))
        if work is not None:
            yield from map(batch, work.end())

    dealt = q.union(t).repartition(g * p, "cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(run, schema)


class _Nearest(Cell):
    """The k best of each query; ties go to the smaller key."""

    def __init__(self, k: int):
        self.k = k

    def start(self, keys, vectors):
        super().start(keys, vectors)
        self.best = np.full(len(keys), np.inf)  # the k-th squared distance, where there are as many
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def block(self, keys, vectors, marks):
        k = self.k
        for at in range(0, len(self.keys), ROWS):
            best = self.best[at : at + ROWS, None]

            def kth(rough: np.ndarray) -> np.ndarray:
                return np.minimum(best, np.partition(rough, k - 1, axis=1)[:, k - 1 : k]) if k < rough.shape[1] else best  # noqa: B023

            i, j, d = near(self.vectors[at : at + ROWS], vectors, kth)
            self.found.append((i + at, d, keys[j]))
            self.size += len(i)
        if self.size > max(1 << 18, 2 * k * len(self.keys)):
            self.trim()
        return iter(())

    def trim(self):
        i, d, t = (np.concatenate(c) for c in zip(*self.found, strict=True))
        by = np.lexsort((t, d, i))
        i, d, t = i[by], d[by], t[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.best[i[last]] = d[last]
        self.found = [(i[place < self.k], d[place < self.k], t[place < self.k])]
        self.size = len(self.found[0][0])

    def end(self):
        if self.found:
            self.trim()
            (i, d, t), = self.found
            for at in range(0, len(i), ROWS * BLOCK):
                s = slice(at, at + ROWS * BLOCK)
                yield self.keys[i[s]], t[s], np.sqrt(d[s])


def k_nearest(queries: DataFrame, train: DataFrame, k: int, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest training rows of each query; ties go to the smaller id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    found = in_cells(queries, train, lambda: _Nearest(k), "query_id long, train_id long, distance double", key, vector)
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy("distance", "train_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


class Radius(Cell):
    """Pairs at most ``radius`` apart, a part at a time: ``pairs`` takes them."""

    def __init__(self, radius: float):
        self.radius = radius

    def parts(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(self.keys), ROWS):
            i, j, d = near(self.vectors[at : at + ROWS], vectors, lambda rough: self.radius * self.radius)
            good = np.sqrt(d) <= self.radius
            yield i[good] + at, j[good], d[good]


class _Pairs(Radius):
    def block(self, keys, vectors, marks):
        for i, j, d in self.parts(vectors):
            yield self.keys[i], keys[j], np.sqrt(d)


def within(queries: DataFrame, train: DataFrame, radius: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """Pairs at most ``radius`` apart."""
    return in_cells(queries, train, lambda: _Pairs(radius), "query_id long, train_id long, distance double", key, vector)


class _Marks(Radius):
    """How many neighbours of each mark a query has."""

    def start(self, keys, vectors):
        super().start(keys, vectors)
        self.counts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def block(self, keys, vectors, marks):
        for i, j, _ in self.parts(vectors):
            self.add(i, marks[j], np.ones(len(i), np.int64))
        return iter(())

    def add(self, i, mark, n):
        by = np.lexsort((mark, i))
        i, mark, n = i[by], mark[by], n[by]
        cut = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (mark[1:] != mark[:-1])][: len(i)])
        if len(cut):
            self.counts.append((i[cut], mark[cut], np.add.reduceat(n, cut)))
            self.size += len(cut)
        if self.size > max(1 << 20, 4 * len(self.keys)) and len(self.counts) > 1:
            self.merge()

    def merge(self):
        i, mark, n = (np.concatenate(c) for c in zip(*self.counts, strict=True))
        self.counts, self.size = [], 0
        by = np.lexsort((mark, i))
        i, mark, n = i[by], mark[by], n[by]
        cut = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (mark[1:] != mark[:-1])][: len(i)])
        self.counts.append((i[cut], mark[cut], np.add.reduceat(n, cut)))

    def end(self):
        if self.counts:
            self.merge()
            (i, mark, n), = self.counts
            for at in range(0, len(i), ROWS * BLOCK):
                s = slice(at, at + ROWS * BLOCK)
                yield self.keys[i[s]], mark[s], n[s]


def marks_within(queries: DataFrame, train: DataFrame, radius: float, mark: str | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, mark, n): how many training rows of each mark are within ``radius``.

    ``mark`` is an integer column of the training rows. Pairs stay in their task.
    """
    found = in_cells(queries, train, lambda: _Marks(radius), "query_id long, mark long, n long", key, vector, mark)
    return found.groupBy("query_id", "mark").agg(F.sum("n").alias("n"))


class _Links(Radius):
    """Components of a cell's pairs: every row in one, with the least key in it."""

    def start(self, keys, vectors):
        super().start(keys, vectors)
        self.root = np.arange(len(keys))
        self.near: list[tuple[np.ndarray, np.ndarray]] = []

    def block(self, keys, vectors, marks):
        some = np.full(len(keys), -1)  # a query next to each training row
        for i, j, _ in self.parts(vectors):
            first = np.full(len(keys), len(self.keys))
            np.minimum.at(first, j, i)
            met = (some >= 0) & (first < len(self.keys))
            pairs = np.concatenate([np.stack([self.root[i], self.root[first[j]]], axis=1), np.stack([self.root[some[met]], self.root[first[met]]], axis=1)])
            self.join(np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0))
            some = np.where((some < 0) & (first < len(self.keys)), first, some)
        got = some >= 0
        self.near.append((keys[got], some[got].astype(np.int32)))
        return iter(())

    def join(self, pairs: np.ndarray) -> None:
        """Joins trees of roots, and flattens them."""
        if not len(pairs):
            return
        root = self.root
        for a, b in pairs.tolist():
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while (root[root] != root).any():
            root = root[root]
        self.root = root

    def end(self):
        if self.near:
            keys, at = (np.concatenate(c) for c in zip(*self.near, strict=True))
            of = self.root[at]
            least = np.full(len(self.keys), np.iinfo(np.int64).max)
            np.minimum.at(least, of, keys)
            np.minimum.at(least, self.root, self.keys)
            for x, y in ((keys, least[of]), (self.keys, least[self.root])):
                for s in range(0, len(x), ROWS * BLOCK):
                    yield x[s : s + ROWS * BLOCK], y[s : s + ROWS * BLOCK]


def linked_within(rows: DataFrame, radius: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """(node, label): labels of components of rows at most ``radius`` apart, by cell. Rows
    of one component that no label joins are joined by the labels of others.
    """
    return in_cells(rows, rows, lambda: _Links(radius), "node long, label long", key, vector).distinct()


def vote(neighbours: DataFrame, labels: DataFrame, weighted: bool = False) -> DataFrame:
    """Label of most weight among each query's neighbours.

    Ties go to the label that reached its weight first in neighbour order.
    ``labels`` has train_id and label.
    """
    rows = neighbours.join(labels, "train_id")
    if weighted:
        zero = F.min("distance").over(W.Window.partitionBy("query_id")) == 0
        weight = F.when(zero, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
        rows = rows.withColumn("w", weight)
    else:
        rows = rows.withColumn("w", F.lit(1.0))
    votes = rows.groupBy("query_id", "label").agg(F.sum("w").alias("w"), F.max("rank").alias("last"))
    best = votes.groupBy("query_id").agg(F.max(F.struct("w", (-F.col("last")).alias("l"), "label")).alias("b"))
    return best.select("query_id", F.col("b.label").alias("pred"))


def weighted_mean(neighbours: DataFrame, values: DataFrame, weighted: bool = False) -> DataFrame:
    """Mean of the neighbours' values; ``values`` has train_id and value."""
    rows = neighbours.join(values, "train_id")
    if weighted:
        zero = F.min("distance").over(W.Window.partitionBy("query_id")) == 0
        w = F.when(zero, F.when(F.col("distance") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    else:
        w = F.lit(1.0)
    rows = rows.withColumn("w", w)
    return rows.groupBy("query_id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("pred"))
