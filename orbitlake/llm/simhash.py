"""Near-duplicate documents by SimHash and tiled exact comparison (operator 8).

Features are pairs of neighbouring folded words (the word itself in a text of one word),
each counted as often as it occurs, hashed to 128 bits; the fingerprint holds the sign of
each bit's sum. Documents whose fingerprints differ in at most ``RADIUS`` bits are linked
if a second sketch agrees: 64 one-bit MinHash values of the set of words, which may
differ in at most ``SKETCH`` bits (half of 1 - Jaccard of them are expected to). Pairs for
which it doesn't are doubtful and are decided by their words: they are linked if the exact
Jaccard index of their words, as sets or counted as often as they occur, is ``ALIKE`` at
least. That keeps apart short texts that share a frequent line, whose few features make the
fingerprint unsteady. Only texts equal in fingerprint and sketch are taken for linked
without a comparison. The links' connected components are the groups.

All other pairs are compared: the distinct (fingerprint, sketch) rows are laid out in
tiles in order of population count; a pair of tiles is skipped when even their nearest
population counts differ beyond the radius (the count of differing bits can't be less), and
so are pairs of the blocks inside tiles. The rest is compared with numpy exclusive-or and
bit counts: first 64 bits for all pairs, then the other 64 for the pairs still possible.
There are as many tiles as give every core a few tile pairs: a row is copied once for each.

Beyond ``DENSE`` rows tiles hold up to ``TILE`` of them, and the pairs of a tile pair are found
by parts of the fingerprint, without losing one: of 8 parts of 16 bits, two fingerprints that
differ in at most 24 bits have one that differs in at most 2, or the first in at most 3 (else
they would differ in 4 + 7 × 3 = 25). So for each value of a part only the rows whose part is
one of the 137 (697) values that near are compared, some 2.5 % of all pairs in all (the
comparison stays quadratic). If tile pairs are fewer than cores want, their parts,
and shares of the parts' values, are tasks of their own.
Each tile pair hands on a spanning forest of its links, so groups of thousands of copies
don't give millions of edges, and the doubtful pairs that the forest doesn't join.

Cases: null and empty texts are each a group of their own; texts without any word are
grouped only if equal; a text of any length is used whole; repeated rows are copies; of a
group the document of the smallest ``doc_id`` is kept (null last), at ties that of the
smallest hash of its text; an empty table gives an empty table; other columns, whatever
their names, are passed through by ``drop_near_duplicates`` and not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, kind, place, positional, sized, thrifty
from .components import components, forest
from .text import Column, mix, prefix_hash, slots, span_hash, words

RADIUS = 24
SKETCH = 12
ALIKE = 0.5
TILE = 1 << 20
DENSE = 1 << 18
PARTS = 8
SHARES = 8  # tile pairs a core
BLOCK = 2_048
_STRIP = 64
_SCHEMA = "k1 bigint, k2 bigint, h0 bigint, h1 bigint, m bigint, pop int"
_rng = np.random.default_rng(8)
_A = (_rng.integers(1, 1 << 32, 64, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, 64, dtype=np.uint64).astype(np.uint32)


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low 64 bits, high 64 bits, MinHash sketch, has words) of every row."""
    n = len(offsets) - 1
    h, count = words(data, offsets)
    h0, h1 = (span_hash(prefix_hash(data ^ np.uint8(x)), offsets[:-1], offsets[1:]) for x in (0, 0x5A))
    some = count > 0
    sketch = np.zeros(n, np.uint64)
    if some.any():
        begin = (np.cumsum(count) - count)[some]
        short = (h >> np.uint64(32)).astype(np.uint32)
        bits = np.zeros(int(some.sum()), np.uint64)
        for k in range(64):
            bits = bits << np.uint64(1) | (mix(np.minimum.reduceat(short * _A[k] + _B[k], begin).astype(np.uint64)) & np.uint64(1))
        sketch[some] = bits
        row = slots(count)
        following = np.zeros_like(h)
        following[:-1] = np.where(row[1:] == row[:-1], h[1:], np.uint64(0))
        place_ = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        keep = place_ <= np.maximum(count - 2, 0)[row]
        feature = mix(h * np.uint64(0x100000001B3) + following)[keep]
        size = np.bincount(row[keep], minlength=n)[some]
        first = np.cumsum(size) - size
        for out, salt in ((h0, 1), (h1, 77_778)):
            bits = np.unpackbits(mix(feature + np.uint64(salt)).view(np.uint8).reshape(-1, 8), axis=1)
            total = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
            out[some] = np.packbits(2 * total > size[:, None], axis=1).view(np.uint64).ravel()
    return h0, h1, sketch, some


def keyed(docs: DataFrame) -> DataFrame:
    """Positional columns plus ``k1, k2``: a 128-bit key of ``doc_id`` and text. Only repeated rows share it."""
    flat = positional(docs)
    i, t = F.col(f"_{place(docs, 'doc_id')}"), F.col(f"_{place(docs, 'text')}")
    return flat.withColumn("k1", F.xxhash64(i, t)).withColumn("k2", F.xxhash64(t, F.lit(7), i))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, h0, h1, m, pop)``, written; ``h0`` null for null and empty texts, ``pop`` null without words."""
    flat = keyed(docs)
    i, t = f"_{place(docs, 'doc_id')}", f"_{place(docs, 'text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = Column(batch.column(3))
            h0 = np.zeros(len(col), np.uint64)
            h1 = np.zeros(len(col), np.uint64)
            m = np.zeros(len(col), np.uint64)
            some = np.zeros(len(col), bool)
            for lo, hi, data, off in col.chunks():
                h0[lo:hi], h1[lo:hi], m[lo:hi], some[lo:hi] = fingerprints(data, off)
            none = np.diff(col.offsets) == 0
            pop = np.bitwise_count(h0).astype(np.int32) + np.bitwise_count(h1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(h0.view(np.int64), mask=none), pa.array(h1.view(np.int64), mask=none), pa.array(m.view(np.int64)), pa.array(pop.astype(np.int32), mask=~some)],
                ["doc_id", "k1", "k2", "h0", "h1", "m", "pop"],
            )

    cols = flat.select(F.col(i).alias("doc_id"), "k1", "k2", F.col(t).alias("text"))
    return cut(cols.mapInArrow(thrifty(run), f"doc_id {kind(docs, 'doc_id')}, {_SCHEMA}"))


def compare(left: tuple, right: tuple | None, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of all pairs within the radius, and whether the sketch agrees; sides are (h0, h1, m, pop), each in order of pop.

    ``right`` None: pairs within the left side. Blocks too far apart in population count are skipped.
    """
    same = right is None
    right = left if same else right
    found_i, found_j, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    a0, a1, am, ap = left
    b0, b1, bm, bp = right
    for j in range(0, len(b0), BLOCK):
        w0, w1, wp = b0[j : j + BLOCK], b1[j : j + BLOCK], bp[j : j + BLOCK]
        for i in range(0, min(len(a0), j + BLOCK) if same else len(a0), _STRIP):
            v0, vp = a0[i : i + _STRIP], ap[i : i + _STRIP]
            if int(vp[0]) - int(wp[-1]) > radius or int(wp[0]) - int(vp[-1]) > radius:
                continue
            d = np.bitwise_count(v0[:, None] ^ w0[None, :])
            at = np.flatnonzero(d.ravel() <= radius)
            if not len(at):
                continue
            x, y = np.divmod(at, len(w0))
            ok = d.ravel()[at].astype(np.int64) + np.bitwise_count(a1[i + x] ^ w1[y]) <= radius
            x, y = x[ok] + i, y[ok] + j
            if same:
                x, y = x[x < y], y[x < y]
            found_i.append(x)
            found_j.append(y)
            found_s.append(np.bitwise_count(am[x] ^ bm[y]) <= SKETCH)
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_s)


def limits(radius: int) -> list[int]:
    """Bits that each part may differ in: two fingerprints within the radius keep to the limit of one part at least (-1: none does).

    Beyond all limits they would differ in the sum of limit + 1, which is radius + 1.
    """
    each, rest = divmod(radius - PARTS + 1, PARTS)
    return [each + (k < rest) for k in range(PARTS)]


def _part(side: tuple, k: int) -> np.ndarray:
    return (side[k // 4] >> np.uint64(16 * (k % 4))).astype(np.uint16)


def compare_parts(left: tuple, right: tuple | None, radius: int, parts: range | list[int], share: int = 0, shares: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``compare``: those of its pairs that are near in one of ``parts``, in none before it, and whose left value of that part falls to the share.

    Over all parts and shares they are the pairs of ``compare``, each once, in either order if ``right`` is None.
    """
    same = right is None
    right = left if same else right
    most = limits(radius)
    weight = np.bitwise_count(np.arange(1 << 16, dtype=np.int64)).astype(np.int64)
    found_i, found_j, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for k in parts:
        ball = np.flatnonzero(weight <= most[k])
        if not len(ball):
            continue
        sides = []
        for side in (left,) if same else (left, right):
            value = _part(side, k)
            order = np.argsort(value, kind="stable")
            size = np.bincount(value, minlength=1 << 16)
            # bits of the other word first: those of the part's own word are near more often
            sides.append((order, size, np.cumsum(size) - size, side[1 - k // 4][order], side[k // 4][order]))
        (oa, na, sa, a1, a0), (ob, nb, sb, b1, b0) = sides[0], sides[-1]
        values = np.flatnonzero(na)
        for v in values[values % shares == share].tolist():
            near = ball ^ v
            if same:
                near = near[near >= v]
            n = nb[near]
            total = np.cumsum(n)
            if not total[-1]:
                continue
            at = np.repeat(sb[near] - (total - n), n)
            at += np.arange(len(at))
            w = b1[at]
            for lo in range(int(sa[v]), int(sa[v] + na[v]), _STRIP):
                hi = min(lo + _STRIP, int(sa[v] + na[v]))
                d = np.bitwise_count(a1[lo:hi, None] ^ w[None, :])
                hit = np.flatnonzero(d.ravel() <= radius)
                if not len(hit):
                    continue
                x, y = np.divmod(hit, len(w))
                x, y = x + lo, at[y]
                ok = d.ravel()[hit].astype(np.int64) + np.bitwise_count(a0[x] ^ b0[y]) <= radius
                i, j = oa[x[ok]], ob[y[ok]]
                if same:
                    once = (i < j) | (_part((left[0][j], left[1][j]), k) != v)
                    i, j = i[once], j[once]
                for e in range(k):
                    new = np.bitwise_count(_part((left[0][i], left[1][i]), e) ^ _part((right[0][j], right[1][j]), e)).astype(np.int64) > most[e]
                    i, j = i[new], j[new]
                found_i.append(i)
                found_j.append(j)
                found_s.append(np.bitwise_count(left[2][i] ^ right[2][j]) <= SKETCH)
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_s)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """Pairs ``(a, b, sure)`` that span every group of ``distinct(node, h0, h1, m, pop)``, once those that aren't sure are decided."""
    spark = distinct.sparkSession
    n_of = {r["pop"]: r["n"] for r in distinct.groupBy("pop").agg(F.count("*").alias("n")).collect()}
    if not n_of:
        return spark.createDataFrame([], "a bigint, b bigint, sure boolean")
    rows, cores = sum(n_of.values()), spark.sparkContext.defaultParallelism
    size = min(tile, -(-rows // math.isqrt(2 * SHARES * cores))) if rows <= dense else -(-rows // -(-rows // tile))
    before, total, range_of = {}, 0, {}
    for p in sorted(n_of):
        before[p] = total
        total += n_of[p]
        for k in range(before[p] // size, (total - 1) // size + 1):
            lo, hi = range_of.get(k, (p, p))
            range_of[k] = (min(lo, p), max(hi, p))
    # a tile's pairs: those with itself and with later tiles within reach of population count
    reach = {k: next((u for u in range(k, len(range_of)) if range_of[u][0] - range_of[k][1] > radius), len(range_of)) for k in range_of}
    counts = spark.createDataFrame([(p, before[p], n_of[p]) for p in n_of], "pop int, before bigint, n bigint")
    spot = F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))
    tiled = distinct.join(F.broadcast(counts), "pop").select((spot / F.lit(size)).cast("bigint").alias("s"), "node", "h0", "h1", "m", "pop")
    first = {k: min(t for t in range_of if reach[t] > k) for k in range_of}
    spans = spark.createDataFrame([(k, first[k], reach[k] - 1) for k in range_of], "s bigint, first bigint, last bigint")
    others = tiled.join(F.broadcast(spans), "s").select("s", "node", "h0", "h1", "m", "pop", F.explode(F.sequence("first", "last")).alias("o"))
    tasks = sum(reach[k] - k for k in range_of)
    split = 1  # of a tile pair
    if rows > dense and tasks < 4 * cores:
        split = PARTS
        while tasks * split < 2 * cores:
            split *= 2
    pairs = others.select("s", "node", "h0", "h1", "m", "pop", F.least("s", "o").alias("t"), F.greatest("s", "o").alias("u"))
    work = pairs.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pop", kind="stable")
        node = pdf["node"].to_numpy()
        sides = (pdf["s"] == key[0]).to_numpy()
        cols = [*(pdf[c].to_numpy().view(np.uint64) for c in ("h0", "h1", "m")), pdf["pop"].to_numpy()]
        left = tuple(c[sides] for c in cols)
        right = None if key[0] == key[1] else tuple(c[~sides] for c in cols)
        if rows <= dense:
            i, j, sure = compare(left, right, radius)
        elif split == 1:
            i, j, sure = compare_parts(left, right, radius, range(PARTS))
        else:
            i, j, sure = compare_parts(left, right, radius, [key[2] % PARTS], key[2] // PARTS, split // PARTS)
        if right is None:
            order = node
        else:
            j = j + len(left[0])
            order = np.concatenate([node[sides], node[~sides]])
        root = forest(len(order), i[sure], j[sure])
        moved = np.flatnonzero(root != np.arange(len(order)))
        open_ = ~sure & (root[i] != root[j])
        a, b = np.concatenate([moved, i[open_]]), np.concatenate([root[moved], j[open_]])
        return pd.DataFrame({"a": order[a], "b": order[b], "sure": np.arange(len(a)) < len(moved)})

    return work.repartition(min(tasks * split, 50_000), "t", "u", "p").groupBy("t", "u", "p").applyInPandas(run, "a bigint, b bigint, sure boolean")


def word_sets(texts: DataFrame) -> DataFrame:
    """``(node, once, all)`` of ``texts(node, text)``: hashes of the different words, and of every word with the number of its occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = Column(batch.column(1))
            for lo, hi, data, off in col.chunks():
                h, count = words(data, off)
                row = slots(count)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                at = np.arange(len(h))
                nth = at - np.maximum.accumulate(np.where(new, at, 0))
                lists = []
                for keys, n in ((h[new], np.bincount(row[new], minlength=hi - lo)), (mix(h + nth.astype(np.uint64) * np.uint64(0x100000001B3)), count)):
                    lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(keys.view(np.int64))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *lists], ["node", "once", "all"])

    return texts.select("node", "text").mapInArrow(thrifty(run), "node bigint, once array<bigint>, all array<bigint>")


def alike(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the doubtful ``pairs(a, b)`` of nodes whose words are alike; a node's words are those of its first document."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = cut(distinct.join(sized(cut(need)), "node").select("node", "k.k1", "k.k2"))
    flat = keyed(docs).select("k1", "k2", F.col(f"_{place(docs, 'text')}").alias("text"))
    texts = flat.join(sized(keys), ["k1", "k2"]).dropDuplicates(["node"])
    sets = cut(word_sets(texts))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("once").alias(f"{side}_once"), F.col("all").alias(f"{side}_all")), side)
    shared = {c: F.size(F.array_intersect(f"a_{c}", f"b_{c}")) for c in ("once", "all")}
    close = [shared[c] >= ALIKE * (F.size(f"a_{c}") + F.size(f"b_{c}") - shared[c]) for c in ("once", "all")]
    return pairs.filter(close[0] | close[1]).select("a", "b")


def group_table(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """``(doc_id, k1, k2, group_key)`` for every row of ``docs``, written."""
    table = fingerprint_table(docs)
    some = table.filter("h0 is not null")
    distinct = cut(some.groupBy("h0", "h1", "m").agg(F.max("pop").alias("pop"), F.min(F.struct("k1", "k2")).alias("k")).withColumn("node", F.monotonically_increasing_id()))
    pairs = cut(links(distinct.filter("pop is not null"), radius, tile, dense))
    edges, doubtful = pairs.filter("sure").select("a", "b"), pairs.filter("not sure").select("a", "b")
    if doubtful.limit(1).count():
        edges = edges.unionByName(alike(docs, distinct, doubtful))
    roots = components(edges)
    node = distinct.select("h0", "h1", "m", "node").join(roots, "node", "left").select("h0", "h1", "m", F.coalesce("root", "node").alias("group_key"))
    grouped = some.join(node, ["h0", "h1", "m"]).select("doc_id", "k1", "k2", "group_key")
    alone = table.filter("h0 is null").select("doc_id", "k1", "k2", F.lit(None).cast("bigint").alias("group_key"))
    return cut(grouped.unionByName(alone))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """``(doc_id, group_id, kept)`` for every row: ``group_id`` is the kept document's ``doc_id``."""
    table = group_table(docs, radius, tile, dense)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    best = table.filter("group_key is not null").groupBy("group_key").agg(F.min(order).alias("o"))
    joined = table.filter("group_key is not null").join(best, "group_key")
    copies = joined.groupBy("doc_id", "k1", "k2", "o").agg(F.count("*").alias("n"))
    first = (F.col("o.k1") == F.col("k1")) & (F.col("o.k2") == F.col("k2"))
    out = copies.select("doc_id", F.col("o.doc_id").alias("group_id"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), first.alias("f"))
    out = out.select("doc_id", "group_id", (F.col("f") & (F.col("i") == 1)).alias("kept"))
    alone = table.filter("group_key is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``docs`` with one document of each group, all columns as they are."""
    table = group_table(docs, radius, tile)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")
    best = table.filter("group_key is not null").groupBy("group_key").agg(F.min(order).alias("o"))
    joined = table.filter("group_key is not null").join(best, "group_key")
    first = (F.col("o.k1") == F.col("k1")) & (F.col("o.k2") == F.col("k2"))
    dropped = cut(joined.filter(~first).select("k1", "k2").distinct())
    repeated = cut(joined.filter(first).groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2"))
    flat = keyed(docs).join(sized(dropped), ["k1", "k2"], "left_anti")
    names = [f"_{i}" for i in range(len(docs.columns))]
    if repeated.limit(1).count():
        once = flat.join(sized(repeated), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        flat = flat.join(sized(repeated), ["k1", "k2"], "left_anti").select(*names).unionByName(once.select(*names))
    return flat.select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
