"""Document fingerprints by prefix polynomial hashes (operator 2).

With code points c_k and a base B, ``P[i]`` is the sum of ``(c_k + 1) * B^k`` over k < i,
modulo a prime; two spans of equal length are equal when ``P[i+l] - P[i]``, multiplied by
the power that aligns it, equals the other's. Two primes near 2^31 are used side by side
(62 bits), so all arithmetic stays in unsigned 64-bit numpy. The arrays answer any span
equality (``span_equal``), and the longest common extension from any two positions by
binary search (``common_extension``); both take pairs of texts, vectorised over a batch.

``fingerprint_documents`` gives, for each document: its length and fingerprint (the whole
span), ``exact_of`` (the smallest ``doc_id`` of equal length and fingerprint), and the
longest prefix and the longest suffix that it has in common with any different text:
``prefix_common`` and ``suffix_common`` characters, with ``prefix_with`` and ``suffix_with``
(the smallest ``doc_id`` of such a text; null where no character is shared).

No pairs are tried: in the order of texts the longest common prefix is one with a neighbour,
so all different texts are range-sorted, and neighbours' extensions are found by binary
search. For suffixes the reversed texts are sorted. What is sorted is cut behind the first
of the lengths 16, 64, 256, … to which no other text shares the prefix, which the prefix
hashes at these lengths tell; so only texts that share much are moved at length.

Cases: a null text has nulls throughout; an empty text shares nothing, and empty texts are
equal to each other; a text of any length is used whole; of the two neighbours, at ties, the
preceding one is named; repeated rows are reported each; a null ``doc_id`` comes after all
others; columns other than ``doc_id`` and ``text`` aren't read, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, kind, pick, sized, thrifty
from .text import Column

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
LEAST = 16
STEP = 4
_CHUNK = 1 << 18


class _Powers:
    def __init__(self, bases: tuple[int, ...]):
        self.bases = bases
        self.tables = [np.ones(1, np.uint64) for _ in PRIMES]

    def get(self, which: int, n: int) -> np.ndarray:
        table, p = self.tables[which], np.uint64(PRIMES[which])
        while len(table) < n:
            step = np.uint64(pow(self.bases[which], len(table), PRIMES[which]))
            table = np.concatenate([table, table * step % p])
        self.tables[which] = table
        return table


_POWERS = _Powers(BASES)
_INVERSE = _Powers(tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES, strict=True)))


class Prefixes:
    """Modular prefix arrays of a batch of texts, laid end to end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        self.off = lead[offsets]
        self.size = np.diff(self.off)
        point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(point)) - np.repeat(self.off[:-1], self.size)
        self.sums = []
        for k, p in enumerate(PRIMES):
            power = _POWERS.get(k, int(self.size.max(initial=0)) + 1)
            total = np.zeros(len(point) + 1, np.uint64)
            np.cumsum(point * power[place] % np.uint64(p), out=total[1:])
            self.sums.append(total)

    def span(self, which: int, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Sum over the span, still scaled by the power of its start."""
        at = self.off[row] + start
        total = self.sums[which]
        return (total[at + length] - total[at]) % np.uint64(PRIMES[which])

    def hashes(self, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """62-bit hash of each span, the same wherever it starts."""
        parts = []
        for k, p in enumerate(PRIMES):
            down = _INVERSE.get(k, int(start.max(initial=0)) + 1)
            parts.append(self.span(k, row, start, length) * down[start] % np.uint64(p))
        return (parts[0] << np.uint64(31) | parts[1]).view(np.int64)

    def whole(self) -> np.ndarray:
        """62-bit fingerprint of each row."""
        row = np.arange(len(self.size))
        return self.hashes(row, np.zeros_like(row), self.size)

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of each row's prefixes and of its suffixes of 16, 64, 256, … characters end to end, and their number by row."""
        lengths = LEAST * STEP ** np.arange(24)
        n = np.searchsorted(lengths, self.size, side="right")
        row = np.repeat(np.arange(len(n)), n)
        length = lengths[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
        return self.hashes(row, np.zeros_like(row), length), self.hashes(row, self.size[row] - length, length), n


def spans_equal(x: Prefixes, i: np.ndarray, y: Prefixes, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Row by row: does ``x`` from ``i`` equal ``y`` from ``j`` over ``length`` characters (all inside)?"""
    row = np.arange(len(length))
    out = np.ones(len(length), bool)
    for k, p in enumerate(PRIMES):
        power = _POWERS.get(k, int(max(i.max(initial=0), j.max(initial=0))) + 1)
        left = x.span(k, row, i, length) * power[np.maximum(j - i, 0)] % np.uint64(p)
        right = y.span(k, row, j, length) * power[np.maximum(i - j, 0)] % np.uint64(p)
        out &= left == right
    return out


def extension(x: Prefixes, i: np.ndarray, y: Prefixes, j: np.ndarray, back: bool = False) -> np.ndarray:
    """Longest common extension of each row's pair, forwards from ``i, j`` or backwards before them."""
    most = np.minimum(i, j) if back else np.minimum(x.size - i, y.size - j)
    lo, hi = np.zeros_like(most), np.maximum(most, 0)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        ok = spans_equal(x, i - mid, y, j - mid, mid) if back else spans_equal(x, i, y, j, mid)
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
    return lo


def _pairwise(left: pa.Array, right: pa.Array) -> Iterator[tuple[int, int, Prefixes, Prefixes]]:
    """Chunks of rows with the prefix arrays of both texts."""
    a, b = Column(left), Column(right)
    lo, n = 0, len(a)
    both = a.offsets + b.offsets
    while lo < n:
        hi = min(max(int(np.searchsorted(both, both[lo] + _CHUNK, side="right")) - 1, lo + 1), n)
        yield lo, hi, *[Prefixes(c.data[c.offsets[lo] : c.offsets[hi]], c.offsets[lo : hi + 1] - c.offsets[lo]) for c in (a, b)]
        lo = hi


def span_equal(pairs: DataFrame) -> DataFrame:
    """``pairs(id, a, i, b, j, length)`` → ``(id, equal)``. False for spans that leave their text; null for null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j, size = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (2, 4, 5))
            out = np.zeros(batch.num_rows, bool)
            for lo, hi, x, y in _pairwise(batch.column(1), batch.column(3)):
                p, q, s = i[lo:hi], j[lo:hi], size[lo:hi]
                ok = (p >= 0) & (q >= 0) & (s >= 0) & (p + s <= x.size) & (q + s <= y.size)
                p, q, s = (np.where(ok, v, 0) for v in (p, q, s))
                out[lo:hi] = ok & spans_equal(x, p, y, q, s)
            none = np.zeros(batch.num_rows, bool)
            for c in batch.columns[1:]:
                none |= np.asarray(c.is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=none)], ["id", "equal"])

    flat = pick(pairs, "id", "a", "i", "b", "j", "length")
    flat = flat.select("id", "a", *[F.col(c).cast("bigint").alias(c) if c != "b" else "b" for c in ("i", "b", "j", "length")])
    return flat.mapInArrow(thrifty(run), f"id {kind(pairs, 'id')}, equal boolean")


def common_extension(pairs: DataFrame) -> DataFrame:
    """``pairs(id, a, i, b, j)`` → ``(id, forward, backward)``: longest common extensions from and before the positions.

    Positions outside their text, and null texts or positions, give nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = (batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in (2, 4))
            none = np.asarray(batch.column(1).is_null()) | np.asarray(batch.column(3).is_null())
            out = np.zeros((2, batch.num_rows), np.int64)
            for lo, hi, x, y in _pairwise(batch.column(1), batch.column(3)):
                p, q = i[lo:hi], j[lo:hi]
                bad = (p < 0) | (q < 0) | (p > x.size) | (q > y.size)
                none[lo:hi] |= bad
                p, q = np.where(bad, 0, p), np.where(bad, 0, q)
                out[0, lo:hi], out[1, lo:hi] = extension(x, p, y, q), extension(x, p, y, q, back=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(o, mask=none) for o in out]], ["id", "forward", "backward"])

    flat = pick(pairs, "id", "a", "i", "b", "j").selectExpr("id", "a", "cast(i as bigint) i", "b", "cast(j as bigint) j")
    return flat.mapInArrow(thrifty(run), f"id {kind(pairs, 'id')}, forward bigint, backward bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, n_chars, fingerprint, prefixes, suffixes)`` per row, written; ``k1, k2`` are a key of ``doc_id`` and text.

    Numbers are null for a null text; the arrays hold the hashes of prefixes and suffixes of 16, 64, … characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = Column(batch.column(3))
            for lo, hi, data, off in col.chunks(_CHUNK):
                p = Prefixes(data, off)
                *hashes, n = p.steps()
                ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                numbers = [pa.array(v, mask=~col.valid[lo:hi]) for v in (p.size, p.whole())]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), *numbers, *[pa.ListArray.from_arrays(ends, pa.array(h)) for h in hashes]], names)

    names = ["doc_id", "k1", "k2", "n_chars", "fingerprint", "prefixes", "suffixes"]
    flat = keyed_texts(docs).select("doc_id", "k1", "k2", "text")
    return cut(flat.mapInArrow(thrifty(run), f"doc_id {kind(docs, 'doc_id')}, k1 bigint, k2 bigint, n_chars bigint, fingerprint bigint, prefixes array<bigint>, suffixes array<bigint>"))


def keyed_texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(7), "doc_id")})


def _reach(texts: DataFrame, hashes: str) -> DataFrame:
    """``(n_chars, fingerprint, reach)``: the length to which a text must be kept to tell it from all others."""
    each = texts.select("n_chars", "fingerprint", F.posexplode(hashes).alias("step", "h"))
    shared = each.groupBy("step", "h").agg(F.count("*").alias("n")).filter("n > 1")
    most = each.join(shared, ["step", "h"]).groupBy("n_chars", "fingerprint").agg(F.max("step").alias("step"))
    return most.select("n_chars", "fingerprint", (LEAST * F.pow(F.lit(STEP), F.col("step") + 1)).cast("int").alias("reach"))


def _neighbours(texts: DataFrame, id_type: str) -> DataFrame:
    """``(n_chars, fingerprint, other, common)`` of ``texts(n_chars, fingerprint, doc_id, key)``: the neighbour in order of ``key`` that shares most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its common prefix with the row before; the keys of the partition's first and last rows."""
        part, at, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(3)
            before = pa.concat_arrays([pa.array([last], keys.type), keys.slice(0, len(keys) - 1)])
            common = np.zeros(len(keys), np.int64)
            for lo, hi, x, y in _pairwise(keys, before):
                zero = np.zeros(hi - lo, np.int64)
                common[lo:hi] = extension(x, zero, y, zero)
            last = keys[len(keys) - 1].as_py()
            edge = np.zeros(len(keys), bool)
            edge[[0, -1] if at == 0 else [-1]] = True  # the last row of each batch: the greatest position of them is the partition's
            place = np.arange(at, at + len(keys))
            at += len(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(keys), part)), pa.array(place), pa.array(common), pc.if_else(pa.array(edge), keys, pa.nulls(len(keys), keys.type))], names)

    names = ["n_chars", "fingerprint", "doc_id", "part", "place", "common", "edge"]
    order = ["key", "n_chars", "fingerprint"]
    ranged = texts.select("n_chars", "fingerprint", "doc_id", "key").repartitionByRange(*order).sortWithinPartitions(*order)
    laid = cut(ranged.mapInArrow(thrifty(run), f"n_chars bigint, fingerprint bigint, doc_id {id_type}, part bigint, place bigint, common bigint, edge string"))
    ends = laid.filter("edge is not null").groupBy("part").agg(
        F.max("place").alias("place"), F.max_by(F.struct("doc_id", "edge"), "place").alias("last"), F.min_by("edge", "place").alias("first")
    )
    line = Window.orderBy("part")  # a row a partition
    seam = ends.select("part", "first", F.lag("last").over(line).alias("b"), F.lag("part").over(line).alias("before"), F.lag("place").over(line).alias("end"))
    seam = cut(seam.filter("before is not null"))
    found = common_extension(seam.select(F.col("part").alias("id"), F.col("first").alias("a"), F.lit(0).alias("i"), F.col("b.edge").alias("b"), F.lit(0).alias("j")))
    seam = cut(seam.join(found.withColumnRenamed("id", "part"), "part").select("part", "before", "end", F.col("b.doc_id").alias("with"), F.col("forward").alias("seam")))
    step = Window.partitionBy("part").orderBy("place")
    both = laid.withColumns({"previous": F.lag("doc_id").over(step), "next": F.lead("doc_id").over(step), "after": F.lead("common").over(step)})
    starts = laid.filter("place = 0").select(F.col("part").alias("p"), F.col("doc_id").alias("follows"))
    after = sized(cut(seam.join(starts, seam["part"] == starts["p"]).select(F.col("before").alias("part"), F.col("end").alias("place"), "follows", F.col("seam").alias("seam_after"))))
    ahead = sized(cut(seam.select("part", F.lit(0).cast("bigint").alias("place"), "with", "seam")))
    both = both.join(ahead, ["part", "place"], "left").join(after, ["part", "place"], "left")
    one, two = F.coalesce("seam", "common"), F.coalesce("seam_after", "after", F.lit(0))
    other = F.when(one >= two, F.when(F.col("seam").isNotNull(), F.col("with")).otherwise(F.col("previous"))).otherwise(F.when(F.col("seam_after").isNotNull(), F.col("follows")).otherwise(F.col("next")))
    most = F.greatest(one, two)
    return both.select("n_chars", "fingerprint", F.when(most > 0, other).alias("other"), most.alias("common"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """See the module's docstring."""
    id_type = kind(docs, "doc_id")
    table = fingerprints(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("o")
    texts = table.filter("fingerprint is not null").groupBy("n_chars", "fingerprint").agg(first, F.first("prefixes").alias("prefixes"), F.first("suffixes").alias("suffixes"))
    texts = cut(texts.select("n_chars", "fingerprint", "o.doc_id", "o.k1", "o.k2", "prefixes", "suffixes"))
    wanted = texts.select("n_chars", "fingerprint", "k1", "k2")
    for hashes in ("prefixes", "suffixes"):
        wanted = wanted.join(_reach(texts, hashes).withColumnRenamed("reach", hashes), ["n_chars", "fingerprint"], "left").fillna(LEAST, [hashes])
    whole = keyed_texts(docs).join(sized(cut(wanted)), ["k1", "k2"])
    head, tail = F.substring("text", F.lit(1), F.col("prefixes")), F.reverse(F.substring("text", F.greatest(F.col("n_chars") - F.col("suffixes"), F.lit(0)).cast("int") + 1, F.col("suffixes")))
    kept = cut(whole.select("n_chars", "fingerprint", "doc_id", head.alias("head"), tail.alias("tail")).dropDuplicates(["n_chars", "fingerprint"]))
    out = texts.select("n_chars", "fingerprint", F.col("doc_id").alias("exact_of"))
    for key, name in (("head", "prefix"), ("tail", "suffix")):
        near = _neighbours(kept.withColumnRenamed(key, "key"), id_type).withColumnsRenamed({"other": f"{name}_with", "common": f"{name}_common"})
        out = out.join(near, ["n_chars", "fingerprint"])
    joined = table.select("doc_id", "n_chars", "fingerprint").join(out, ["n_chars", "fingerprint"], "left")
    return joined.select("doc_id", "n_chars", "fingerprint", "exact_of", "prefix_with", "prefix_common", "suffix_with", "suffix_common")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _horner_sql(which: int) -> str:
    points = "list_reverse(list_transform(string_split(text, ''), lambda c: (ord(c) + 1)::BIGINT))"
    return f"list_reduce({points}, lambda acc, c: (acc * {BASES[which]} + c) % {PRIMES[which]})"


def _common_sql(a: str, b: str) -> str:
    zipped = f"list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda t: t[1] IS NOT DISTINCT FROM t[2])"
    return f"CASE WHEN least(length({a}), length({b})) = 0 THEN 0 ELSE coalesce(nullif(list_position({zipped}, false), 0) - 1, least(length({a}), length({b}))) END"


SQL = f"""
WITH fp AS (
  SELECT doc_id, ({_horner_sql(0)} * 2147483648 + {_horner_sql(1)})::BIGINT AS f FROM documents WHERE length(text) > 0),
d AS (
  SELECT doc_id, text, length(text)::BIGINT AS n_chars, CASE WHEN text IS NULL THEN NULL ELSE coalesce(f, 0) END AS fingerprint
  FROM documents LEFT JOIN fp USING (doc_id)),
t AS (SELECT text, reverse(text) AS back, min(doc_id) AS exact_of FROM documents WHERE text IS NOT NULL GROUP BY text),
n AS (
  SELECT *, lag(text) OVER p AS t1, lag(exact_of) OVER p AS i1, lead(text) OVER p AS t2, lead(exact_of) OVER p AS i2,
         lag(back) OVER s AS b1, lag(exact_of) OVER s AS j1, lead(back) OVER s AS b2, lead(exact_of) OVER s AS j2
  FROM t WINDOW p AS (ORDER BY text), s AS (ORDER BY back)),
c AS (
  SELECT text, exact_of, i1, i2, j1, j2, coalesce({_common_sql("text", "t1")}, 0) AS p1, coalesce({_common_sql("text", "t2")}, 0) AS p2,
         coalesce({_common_sql("back", "b1")}, 0) AS s1, coalesce({_common_sql("back", "b2")}, 0) AS s2 FROM n)
SELECT doc_id, n_chars, fingerprint, exact_of,
  CASE WHEN greatest(p1, p2) > 0 THEN CASE WHEN p1 >= p2 THEN i1 ELSE i2 END END AS prefix_with, greatest(p1, p2)::BIGINT AS prefix_common,
  CASE WHEN greatest(s1, s2) > 0 THEN CASE WHEN s1 >= s2 THEN j1 ELSE j2 END END AS suffix_with, greatest(s1, s2)::BIGINT AS suffix_common
FROM d LEFT JOIN c ON c.text = d.text"""
