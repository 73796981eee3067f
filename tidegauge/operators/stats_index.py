"""A hierarchy of stats, and range aggregates answered from it.

Level 1 nodes cover ``base`` positions; a node of the next level covers
``fanout`` complete nodes below it; level 0 is the whole column. A range is
rewritten into the largest nodes inside it and rows at its edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import merge_stats, segment_stats

BASE, FANOUT = 10_000, 8


def build(points: DataFrame, levels: int, base: int = BASE, fanout: int = FANOUT) -> DataFrame:
    """Stats of all levels. A short last node of level 1 is kept; upper nodes are complete."""
    first = segment_stats(points, base).withColumn("avg", F.col("sum") / F.col("count"))
    out, below = [first.withColumn("level", F.lit(1))], first.filter(F.col("count") == base)
    for level in range(2, levels + 1):
        node = F.floor(F.col("node") / fanout).cast("long").alias("node")
        below = merge_stats(below, [node]).filter(F.col("count") == base * fanout ** (level - 1))
        out.append(below.withColumn("level", F.lit(level)))
    out.append(merge_stats(first).withColumns({"level": F.lit(0), "node": F.lit(0).cast("long")}))
    columns = ["level", "node", "start", "end", "max", "min", "sum", "count", "avg"]
    return reduce(DataFrame.union, [d.select(columns) for d in out])


def cover(lo: int, hi: int, levels: int, base: int = BASE, fanout: int = FANOUT) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Runs of nodes (level, first, last) and edge ranges that make up lo <= idx < hi."""
    nodes: list[tuple[int, int, int]] = []
    first, last = -(-lo // base), hi // base
    if first >= last:
        return nodes, [(lo, hi)] if lo < hi else []
    edges = [(a, b) for a, b in ((lo, first * base), (last * base, hi)) if a < b]
    for level in range(1, levels + 1):
        up_first, up_last = -(-first // fanout), last // fanout
        if level == levels or up_first >= up_last:
            nodes.append((level, first, last - 1))
            break
        nodes += [(level, a, b - 1) for a, b in ((first, up_first * fanout), (up_last * fanout, last)) if a < b]
        first, last = up_first, up_last
    return nodes, edges


def range_stats(index: DataFrame, points: DataFrame, lo: int, hi: int, levels: int, base: int = BASE, fanout: int = FANOUT) -> DataFrame:
    """Stats of lo <= idx < hi from nodes and edge rows, for a range within the column."""
    nodes, edges = cover(lo, hi, levels, base, fanout)
    no = F.lit(False)
    in_nodes = reduce(lambda c, n: c | ((F.col("level") == n[0]) & F.col("node").between(n[1], n[2])), nodes, no)
    in_edges = reduce(lambda c, e: c | ((F.col("idx") >= e[0]) & (F.col("idx") < e[1])), edges, no)
    columns = ["start", "end", "max", "min", "sum", "count"]
    rows = segment_stats(points.filter(in_edges), base)
    return merge_stats(index.filter(in_nodes).select(columns).union(rows.select(columns)))
