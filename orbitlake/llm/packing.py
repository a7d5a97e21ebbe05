"""Packing documents along a space-filling curve (operator 10).

A document is the L2-normalised vector of its folded words' sublinear counts, hashed to
``BUCKETS`` places, and projected by a fixed Gaussian matrix to ``AXES`` dimensions. Each
dimension is standardised with the mean and deviation over all documents and cut into
2^``BITS`` cells; the cell's Hilbert index is the key. Documents are range-sorted by key,
and the sorted sequence, each document followed by one separator token, is cut into packs
of ``LENGTH`` tokens, so neighbours along the curve share packs and no token is lost.
Positions come from running sums within the range partitions plus the partitions' offsets.

One row per piece: ``pack_id``, ``pack_start`` (its first token's place in the pack),
``doc_id``, ``doc_start`` (the piece's first token in the document), ``n_tokens``
(separator included, in the last piece), ``curve_key`` and ``text``, the piece itself:
from its first token to the next piece's, so a document's pieces end to end are its text.
Tokens are runs without white space. Texts are shuffled once, into the order of the curve.

Cases: null, empty and blank texts hold no token and are left out; ties on the key are in
order of ``doc_id`` (null last), then of the text's hash; repeated rows are packed each; a
document longer than a pack spans several, whole; columns other than ``doc_id`` and
``text`` aren't read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, kind, pick, sized, thrifty
from .text import SPACE, Column, runs, slots, words

BUCKETS = 512
AXES = 3
BITS = 16
LENGTH = 2_048
SPREAD = 4.0
_ROWS = 512
_PROJECTION = np.random.default_rng(10).normal(size=(BUCKETS, AXES)).astype(np.float32)


def project(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Coordinates (rows, AXES) of the hashed document vectors; zero without words."""
    rows = len(offsets) - 1
    h, count = words(data, offsets)
    at = slots(count) * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)
    x = np.log1p(np.bincount(at, minlength=rows * BUCKETS).reshape(rows, BUCKETS).astype(np.float32))
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    norm[norm == 0] = 1
    return ((x / norm[:, None]) @ _PROJECTION).astype(np.float64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells (rows, axes), by Skilling's transposed Gray code."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            flipped = x[0] ^ p
            exchanged = x[0] ^ swap
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
            x[0] = np.where(high, flipped, exchanged if i else x[0])
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def _coordinates(col: Column) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, number of tokens) of the rows of a column of texts."""
    x, n = np.zeros((len(col), AXES)), np.zeros(len(col), np.int64)
    for lo, hi, data, off in col.chunks():
        start, _ = runs(~SPACE[data], off)
        n[lo:hi] = np.diff(np.searchsorted(start, off))
        x[lo:hi] = project(data, off)
    return x, n


def moments(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each coordinate over all documents that hold a token."""
    axes = [f"x{a}" for a in range(AXES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _coordinates(Column(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(x[n > 0, a]) for a in range(AXES)], axes)

    table = pick(docs, "text").mapInArrow(thrifty(run), ", ".join(f"{a} double" for a in axes))
    stats = table.agg(*[F.avg(a) for a in axes], *[F.stddev_pop(a) for a in axes]).first()
    return np.array([v or 0.0 for v in stats[:AXES]]), np.array([v or 1.0 for v in stats[AXES:]])


def curve_key(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale / (2 * SPREAD) + 0.5, 0, 1)
    return hilbert(np.minimum(np.floor(z * (1 << BITS)), (1 << BITS) - 1).astype(np.int64))


def _pieces(start: np.ndarray, n: np.ndarray, col: Column, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, pack, place in the pack, place in the document, tokens, text) of the pieces of rows that begin at ``start``."""
    first = start // length
    count = (start + n) // length - first + 1  # n tokens and the separator
    row = np.repeat(np.arange(len(n)), count)
    pack_id = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(start[row], pack_id * length)
    end = np.minimum((start + n + 1)[row], (pack_id + 1) * length)
    token, _ = runs(~SPACE[col.data[col.offsets[0] : col.offsets[-1]]], col.offsets - col.offsets[0])
    off, skip = col.offsets - col.offsets[0], begin - start[row]
    before = np.cumsum(n) - n
    at = np.append(token, off[-1])[np.minimum(before[row] + skip, len(token))]
    at = np.where(skip == 0, off[:-1][row], np.where(skip >= n[row], off[1:][row], at))
    cuts = np.append(at, off[-1]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(cuts.tobytes()), pa.py_buffer(col.data[col.offsets[0] : col.offsets[-1]].tobytes()))
    return row, pack_id, begin - pack_id * length, skip, end - begin, text.cast(pa.string())


def pack(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces of all packs; see the module's docstring."""
    id_type = kind(docs, "doc_id")
    mean, scale = moments(docs)
    fields = f"doc_id {id_type}, h bigint, n_tokens bigint, curve_key bigint, text string"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _coordinates(Column(batch.column(2)))
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(curve_key(x, mean, scale)), batch.column(2)], ["doc_id", "h", "n_tokens", "curve_key", "text"])
            yield out.filter(pa.array(n > 0))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            end = at + np.cumsum(batch.column(1).to_numpy(zero_copy_only=False) + 1)
            start = np.append(at, end[:-1]) if batch.num_rows else end
            at = int(end[-1]) if batch.num_rows else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start.astype(np.int64)), pa.array(np.full(batch.num_rows, part, np.int64))], ["doc_id", "n_tokens", "curve_key", "text", "start", "part"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 1))
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                row, *numbers, text = _pieces(start[lo : lo + _ROWS], n[lo : lo + _ROWS], Column(part.column(3)), length)
                row = pa.array(row)
                pack_id, pack_start, doc_start, tokens = map(pa.array, numbers)
                yield pa.RecordBatch.from_arrays([pack_id, pack_start, part.column(0).take(row), doc_start, tokens, part.column(2).take(row), text], names)

    names = ["pack_id", "pack_start", "doc_id", "doc_start", "n_tokens", "curve_key", "text"]
    order = ["curve_key", F.col("doc_id").isNull(), "doc_id", "h"]
    keyed = cut(pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(thrifty(key), fields), "zstd")
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "curve_key", "text")
    laid = cut(ranged.mapInArrow(thrifty(lay), f"doc_id {id_type}, n_tokens bigint, curve_key bigint, text string, start bigint, part bigint"), "zstd")
    parts = laid.groupBy("part").agg(F.sum(F.col("n_tokens") + 1).alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(parts.select("part", before.alias("offset")))
    spans = laid.join(sized(offsets), "part").select("doc_id", "n_tokens", "curve_key", "text", (F.col("start") + F.col("offset")).alias("s"))
    return spans.mapInArrow(thrifty(split), f"pack_id bigint, pack_start bigint, doc_id {id_type}, doc_start bigint, n_tokens bigint, curve_key bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
