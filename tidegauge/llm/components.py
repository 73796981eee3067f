"""Connected components by hooking and pointer jumping, without a driver-side graph.

Rounds over the cluster contract the graph until what is left is small; a small
graph is solved by one task, within a checked number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, maybe_broadcast, stored

BROADCAST_ROWS = 500_000  # pointers that are broadcast at most; beyond, tables are joined
TASK_EDGES = 1_000_000  # edges that one task solves at most: 16 MB


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) in which parents are smaller.

    Every round doubles the reach of a pointer.
    """
    p = stored(parents.toDF("node", "root"), "pointers")
    while True:
        up = maybe_broadcast(p.toDF("root", "above"), BROADCAST_ROWS)
        q = stored(p.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "pointers")
        p = q.select("node", "root")
        if q.filter("moved").isEmpty():
            return p


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        np.minimum.at(up, high, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        open_edges = up[a] != up[b]
        a, b = a[open_edges], b[open_edges]
    return nodes, nodes[up]


def in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of a graph whose size was checked; roots have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if cols:
            node, root = smallest(*(np.concatenate(c) for c in zip(*cols, strict=True)))
            moved = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(root[moved])], names=["node", "root"])

    return stored(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, root long"), "found")


def refined(found: DataFrame, step: DataFrame) -> DataFrame:
    """Roots of ``found`` (node, root) followed through ``step``, whose nodes are roots of it."""
    on = maybe_broadcast(step.toDF("root", "next"), BROADCAST_ROWS)
    moved = found.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stored(moved.union(step), "found")


def contracted(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (u, v) between the roots of ``found``; those inside a component go."""
    for c in ("u", "v"):
        edges = edges.join(maybe_broadcast(found.toDF(c, "to"), BROADCAST_ROWS), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")


def components(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node with an edge to another; the root is its
    component's smallest node, which has no row.

    ``edges`` has two long columns. With ``found``, components that are known
    already (a stored table), edges join those. Each round hooks every node to its
    smallest smaller neighbour, follows the pointers to their roots, and contracts
    the edges; contracted graphs shrink fast. Rounds are written to the shared folder.
    """
    e = edges.toDF("u", "v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v"), "edges") if found is None else contracted(e, found)
    while True:
        last = bounded(e, TASK_EDGES)
        step = in_one_task(e) if last else roots(e.groupBy("u").agg(F.min("v").alias("p")))
        found = step if found is None else refined(found, step)
        if last or (e := contracted(e, step)).isEmpty():
            return found
