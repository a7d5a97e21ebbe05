"""Exact top-k search with an M-tree, best first (operator 9).

Vectors are compared by Euclidean distance (on unit vectors that is the order of cosines).
The index is one M-tree, paged in the shared folder. Its upper nodes are shards: each
vector belongs to that of its nearest pivot, pivots being the vectors of the smallest
hashes, one for every ``SHARD`` vectors (or for every sqrt(n), where that is more, so that
neither shards nor pivots outgrow a worker). A shard is a file that holds its own tree of
nodes of ``PAGE`` entries. A node keeps its routing object, its covering radius and its
entries' distances to that object (the parent distances), so ``|d(q, parent) - d(parent,
entry)| - radius`` bounds an entry's distance from below without computing it.

Queries are the rows whose ``vec_id`` is divisible by ``EVERY`` (an id that isn't a number
never is); they are searched against all rows, those of a shard together, beginning there; then come
the other shards in order of their lower bounds, each read only if for some query its bound
is below the k-th distance so far. Within a shard every query descends by its own bounds,
computes no distance to a node that they exclude, and visits the leaves left to it best
first, until the next bound exceeds its k-th distance; the queries that want the same node
are served by one numpy product. Distances reported, and ties, are computed from the
differences in float64. Trees are built and written once, and queries are read from them,
so vectors are shuffled once and never copied. The neighbours found are written before
ids are joined to them: the size of what Python returns can't be guessed, and a guess too
low would send them all to the driver for a broadcast.

Result: ``(vec_id, rank, neighbor_id, distance)`` of the queries, ``rank`` from 1 to k by distance, at ties
by ``neighbor_id``; a row isn't a neighbour of itself.

Cases: a null vector, one with a null, NaN or infinite element, and one of another length
than most vectors (ties: the longer) take no part; fewer than k other rows give as many; a
null ``vec_id`` is a row like any other, last among ties; rows that repeat are neighbours
of each other at distance 0, in whatever number; columns other than the two aren't read,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kind, pick, read_file, scratch_path, thrifty, write_file

K = 10
EVERY = 50
SHARD = 8_192
PAGE = 256
FANOUT = 16
QUERIES = 4_096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs by one product."""
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def _slack(*parts: np.ndarray) -> float:
    """More than ``distances`` errs by."""
    return 1e-7 * (1 + max(math.sqrt(float(np.einsum("ij,ij->i", p, p).max(initial=0))) for p in parts))


class Tree:
    """Rows in order of leaves, and nodes, the root first, each with the range of its rows (leaves) or nodes.

    ``rid`` names the rows, ``ask`` tells which are queries; ``to_leaf`` and ``to_parent`` are the parent distances of rows and nodes.
    """

    FIELDS = ("x", "rid", "ask", "to_leaf", "at", "radius", "to_parent", "begin", "end", "leaf")

    def __init__(self, x, rid, ask, to_leaf, at, radius, to_parent, begin, end, leaf):
        self.x, self.rid, self.ask, self.to_leaf, self.at, self.radius, self.to_parent, self.begin, self.end, self.leaf = x, rid, ask, to_leaf, at, radius, to_parent, begin, end, leaf

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as z:
            return cls(*(z[f] for f in cls.FIELDS))


def build(x: np.ndarray, rid: np.ndarray, ask: np.ndarray, page: int = PAGE) -> Tree:
    """Bulk-load an M-tree over the rows of ``x``, splitting between two far objects until a page holds the part."""
    leaves, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= page:
            leaves.append(rows)
            continue
        one = x[rows[np.linalg.norm(x[rows] - x[rows[0]], axis=1).argmax()]]
        d = np.linalg.norm(x[rows] - one, axis=1)
        two = x[rows[d.argmax()]]
        order = np.argsort(d - np.linalg.norm(x[rows] - two, axis=1), kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    order, to_leaf, level, row = [], [], [], 0
    for rows in leaves:
        at = x[rows[np.linalg.norm(x[rows] - x[rows].mean(0), axis=1).argmin()]]
        d = np.linalg.norm(x[rows] - at, axis=1)
        near = np.argsort(d, kind="stable")
        order.append(rows[near])
        to_leaf.append(d[near])
        level.append((at, float(d.max()), row, row + len(rows), True))
        row += len(rows)
    levels = [level]
    while len(levels[-1]) > 1:
        below, above = levels[-1], []
        for i in range(0, len(below), FANOUT):
            group = below[i : i + FANOUT]
            radius = max(float(np.linalg.norm(g[0] - group[0][0])) + g[1] for g in group)
            above.append((group[0][0], radius, i, i + len(group), False))
        levels.append(above)
    levels.reverse()
    starts = np.cumsum([0, *map(len, levels)])
    nodes = [(at, r, b if leaf else b + starts[depth + 1], e if leaf else e + starts[depth + 1], leaf) for depth, group in enumerate(levels) for at, r, b, e, leaf in group]
    at = np.stack([n[0] for n in nodes])
    to_parent = np.zeros(len(nodes))
    for n, (_, _, b, e, leaf) in enumerate(nodes):
        if not leaf:
            to_parent[b:e] = np.linalg.norm(at[b:e] - at[n], axis=1)
    order = np.concatenate(order)
    radius, begin, end, leaf = (np.array([n[i] for n in nodes]) for i in range(1, 5))
    return Tree(x[order], rid[order], ask[order], np.concatenate(to_leaf), at, radius, to_parent, begin, end, leaf)


class Best:
    """The k nearest rows so far of each query, and its k-th distance."""

    def __init__(self, q: np.ndarray, rid: np.ndarray, k: int):
        self.q, self.rid, self.k = q, rid, k
        self.d, self.r = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.bound, self.computed = np.full(len(q), np.inf), 0

    def merge(self, who: np.ndarray, r: np.ndarray, d: np.ndarray) -> None:
        touched = np.unique(who)
        w = np.concatenate([who, np.repeat(touched, self.k)])
        r = np.concatenate([r, self.r[touched].ravel()])
        v = np.concatenate([d, self.d[touched].ravel()])
        o = np.lexsort((r, v, w))
        take = np.searchsorted(w[o], touched)[:, None] + np.arange(self.k)[None, :]
        self.d[touched], self.r[touched] = v[o][take], r[o][take]
        self.bound[touched] = self.d[touched, -1]


def search(tree: Tree, best: Best) -> None:
    """Take the rows of ``tree`` into ``best``."""
    q, slack = best.q, _slack(best.q, tree.x)
    everyone = np.arange(len(q))
    open_, leaves = [(0, everyone, distances(q, tree.at[:1])[:, 0])], []
    best.computed += len(q)
    while open_:
        node, who, d = open_.pop()
        low = d - tree.radius[node]
        stay = low <= best.bound[who] + slack
        who, d, low = who[stay], d[stay], low[stay]
        if not len(who):
            continue
        if tree.leaf[node]:
            leaves.append((np.full(len(who), node), who, d, low))
            continue
        for child in range(tree.begin[node], tree.end[node]):
            may = np.abs(d - tree.to_parent[child]) - tree.radius[child] <= best.bound[who] + slack
            some = who[may]
            if len(some):
                open_.append((child, some, distances(q[some], tree.at[child : child + 1])[:, 0]))
                best.computed += len(some)
    if not leaves:
        return
    page, who, d, low = map(np.concatenate, zip(*leaves, strict=True))
    order = np.lexsort((low, who))
    page, who, d, low = page[order], who[order], d[order], low[order]
    turn = np.arange(len(who)) - np.searchsorted(who, who)
    order = np.lexsort((page, turn))
    page, who, d, low, turn = page[order], who[order], d[order], low[order], turn[order]
    cuts = np.flatnonzero((np.diff(turn) != 0) | (np.diff(page) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(who)], strict=True):
        alive = low[lo:hi] <= best.bound[who[lo:hi]] + slack
        some, far = who[lo:hi][alive], d[lo:hi][alive]
        if not len(some):
            continue
        first, reach = int(tree.begin[page[lo]]), best.bound[some] + slack
        inside = tree.to_leaf[first : tree.end[page[lo]]]
        begin = first + int(np.searchsorted(inside, (far - reach).min(), side="left"))
        end = first + int(np.searchsorted(inside, (far + reach).max(), side="right"))
        if begin >= end:
            continue
        found = distances(q[some], tree.x[begin:end])
        best.computed += found.size
        w, c = np.nonzero((found <= reach[:, None]) & (tree.rid[None, begin:end] != best.rid[some][:, None]))
        if len(w):
            best.merge(some[w], tree.rid[begin + c], np.sqrt(((q[some[w]] - tree.x[begin + c]) ** 2).sum(1)))


def _vectors(table: DataFrame, every: int) -> DataFrame:
    """Valid rows ``(rid, vec_id, v, ask)``, written; ``rid`` numbers the rows in order of ``vec_id``, ``ask`` tells which are queries."""
    flat = pick(table, "vec_id", "embedding").withColumnRenamed("embedding", "v")
    if flat.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        flat = flat.withColumn("v", F.col("v").cast("array<double>"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    flat = flat.filter("v is not null and size(v) > 0").filter(~bad)
    top = flat.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    flat = flat.filter(F.size("v") == (top["n"] if top else 0))
    asks = F.lit(True) if every == 1 else F.coalesce(F.expr(f"try_cast(vec_id as decimal(38,0)) % {every} = 0"), F.lit(False))
    return cut(flat.orderBy(F.col("vec_id").isNull(), "vec_id", F.xxhash64("v")).withColumns({"rid": F.monotonically_increasing_id(), "ask": asks}))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 0))


def _assign(rows: DataFrame, n: int, shard: int) -> DataFrame:
    """``(rid, v, ask, s)``, written: each vector with its nearest pivot."""
    spark = rows.sparkSession
    chosen = rows.orderBy(F.xxhash64("v", "rid")).limit(-(-n // max(shard, math.isqrt(n)))).select("v").toArrow()
    pivots = spark.sparkContext.broadcast(_matrix(chosen.column(0).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                near = distances(_matrix(part.column(1)), pivots.value).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int64))], ["rid", "v", "ask", "s"])

    return cut(rows.select("rid", "v", "ask").mapInArrow(thrifty(run), f"rid bigint, v {rows.schema['v'].dataType.simpleString()}, ask boolean, s bigint"))


def _shards(placed: DataFrame, shard: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Build and write the shards' trees: paths, root objects, root radii, numbers of queries. A crowded pivot (copies) gets several shards."""
    spark, folder = placed.sparkSession, scratch_path(placed.sparkSession)
    crowd = {r["s"]: r["n"] for r in placed.groupBy("s").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame([(s, -(-n // (4 * shard))) for s, n in crowd.items()], "s bigint, parts bigint")
    split = placed.join(F.broadcast(parts), "s").select("rid", "v", "ask", "s", F.pmod(F.xxhash64("rid"), "parts").alias("p"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", kind="stable")
        tree = build(np.stack([np.asarray(v, np.float64) for v in pdf["v"]]), pdf["rid"].to_numpy(), pdf["ask"].to_numpy())
        path = f"{folder}/{key[0]}-{key[1]}.npz"
        write_file(path, tree.dump())
        return pd.DataFrame({"path": [path], "at": [tree.at[0].tolist()], "radius": [float(tree.radius[0])], "n": [int(tree.ask.sum())]})

    made = cut(split.groupBy("s", "p").applyInPandas(run, "path string, at array<double>, radius double, n bigint")).orderBy("path").toArrow()
    return made.column("path").to_pylist(), _matrix(made.column("at").combine_chunks()), made.column("radius").to_numpy(), made.column("n").to_numpy()


def _groups(asked: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """Queries in groups of ``size``: a group's parts ``(shard, first, last)`` of the queries of neighbouring shards."""
    out, room = [], 0
    for s, n in enumerate(asked):
        at = 0
        while at < n:
            if not room:
                out.append([])
                room = size
            to = min(n, at + room)
            out[-1].append((s, at, to))
            room -= to - at
            at = to
    return out


def top_k(table: DataFrame, k: int = K, shard: int = SHARD, computed=None, every: int = 1) -> DataFrame:
    """Exact k nearest neighbours, among all rows of ``table(vec_id, embedding)``, of those whose ``vec_id`` is divisible by ``every`` (1: of all).

    ``computed``: an accumulator of distances computed.
    """
    id_type, spark = kind(table, "vec_id"), table.sparkSession
    rows = _vectors(table, every)
    n = rows.count()
    paths, at, radius, asked = _shards(_assign(rows, n, shard), shard) if n else ([], None, None, np.zeros(0, np.int64))
    if not asked.sum():
        return spark.createDataFrame([], f"vec_id {id_type}, rank int, neighbor_id {id_type}, distance double")
    groups = _groups(asked.tolist(), min(QUERIES, -(-int(asked.sum()) // (2 * spark.sparkContext.defaultParallelism))))
    shared = spark.sparkContext.broadcast((paths, at, radius, groups))
    todo = spark.range(len(groups)).repartitionByRange(min(len(groups), 50_000), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, at, radius, groups = shared.value
        for batch in batches:
            for group in batch.column(0).to_pylist():
                x, rid = [], []
                for s, lo, to in groups[group]:
                    home = Tree.load(read_file(paths[s]))
                    mine = np.flatnonzero(home.ask)[lo:to]
                    x.append(home.x[mine])
                    rid.append(home.rid[mine])
                best = Best(np.concatenate(x), np.concatenate(rid), k)
                low = distances(best.q, at) - radius[None, :]
                best.computed += low.size
                slack = _slack(best.q, at)

                def take(tree: Tree, some: np.ndarray) -> None:
                    part = Best(best.q[some], best.rid[some], k)
                    part.d, part.r, part.bound = best.d[some], best.r[some], best.bound[some]
                    search(tree, part)
                    best.d[some], best.r[some], best.bound[some] = part.d, part.r, part.bound
                    best.computed += part.computed

                begin = 0
                for (s, _, _), part in zip(groups[group], rid, strict=True):
                    own = np.arange(begin, begin + len(part))
                    take(Tree.load(read_file(paths[s])), own)
                    low[own, s] = np.inf
                    begin += len(part)
                for other in np.argsort(low.min(0), kind="stable").tolist():
                    some = np.flatnonzero((low[:, other] <= best.bound + slack) & (low[:, other] < np.inf))
                    if len(some):
                        take(Tree.load(read_file(paths[other])), some)
                if computed is not None:
                    computed.add(best.computed)
                hit = np.isfinite(best.d)
                rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), hit.shape)[hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.rid, hit.sum(1))), pa.array(rank), pa.array(best.r[hit]), pa.array(best.d[hit])], ["q", "rank", "r", "distance"])

    found = cut(todo.mapInArrow(thrifty(run), "q bigint, rank int, r bigint, distance double"))
    named = rows.select("rid", "vec_id")
    other = named.select(F.col("rid").alias("r"), F.col("vec_id").alias("neighbor_id"))
    asking = rows.filter("ask").select(F.col("rid").alias("q"), "vec_id")
    return found.join(other, "r").join(asking, "q").select("vec_id", "rank", "neighbor_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances are rounded to 6 digits, as float sums differ in their last bits between engines."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY).withColumn("distance", F.round("distance", 6))


SQL = f"""
WITH p AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id)::INT AS rank FROM p)
SELECT vec_id, rank, neighbor_id, round(d, 6) AS distance FROM r WHERE rank <= {K}"""
