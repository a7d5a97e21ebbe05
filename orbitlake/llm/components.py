"""Connected components: a distributed union-find.

Every partition first replaces its edges by a spanning forest. Then large-star and
small-star steps alternate; once the remaining edges fit one task (they are counted), a
last union-find over them ends it. The result is the same wherever that happens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, thrifty


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest member) of each of ``n`` items under the links ``a``–``b``; vectorised hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _stamp(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
    return out.filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return links.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


#: Edges (two longs each) that one task joins up at the end.
LOCAL = 2_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's edges: each node with the smallest one that it is linked to."""
    sides = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for side, column in zip(sides, batch.columns, strict=True):
            side.append(column.to_numpy(zero_copy_only=False))
    a, b = map(np.concatenate, sides)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[forest(len(nodes), at[: len(a)], at[len(a) :])]
    moved = root != nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(root[moved])], ["a", "b"])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; ``root`` is the smallest node of its component.

    Every round is written to the shared folder. Self-links and repeated links are allowed
    (a node that is only linked to itself is left out); no edge gives an empty table.
    """
    now = cut(edges.select("a", "b").mapInArrow(thrifty(_contract), "a bigint, b bigint"))
    seen = _stamp(now)
    while seen[0] > local:
        now = cut(_small(_large(now)))
        stamp = _stamp(now)
        if stamp == seen:
            break
        seen = stamp
    else:
        now = cut(now.coalesce(1).mapInArrow(thrifty(_contract), "a bigint, b bigint"))
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
