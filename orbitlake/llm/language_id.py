"""Language identification by nearest centroid (operator 4).

A document is the L2-normalised TF-IDF vector of its byte trigrams (of the folded words,
each between blanks), hashed to ``DIMENSIONS`` buckets, with sublinear term frequencies.
Inverse document frequencies are counted over all documents. Each language has
``CENTROIDS`` centroids from spherical k-means on at most ``SAMPLE`` labelled documents a
language (those of the smallest hash of their text). The label is that of the centroid of
the highest cosine.

Rejection is by distance. Short texts have few n-grams and lie farther from any centroid,
so the cosine is divided by what a text of as many n-grams is expected to reach
(``a * sqrt(n / (n + c))``, fitted on the sample); a document is rejected when that ratio
is under a limit, which rises with the number of different n-grams: junk of many n-grams
meets more of any centroid's buckets, and genuine text of many comes near to its centroid.
Up to ``FEW`` the limit is ``ACCEPT``, from ``MANY`` on it is 0.4 of what all but 1 % of
the sample's texts of as many reach, ``STRICT`` at least, and between them it is linear.
A text that repeats few words has few different n-grams, however long it is.

Cases: null, empty and letterless texts are rejected (null label, score 0); labels that
are null don't take part in the fit; without any labelled text everything is rejected;
ties go to the language first in order; repeated rows are labelled alike; texts of any
length are used whole; columns other than those named aren't read, and are passed through
by ``keep_identified`` whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, kind, pick, place, positional, sized, thrifty
from .text import WORD, Column, fold

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 300
ACCEPT = 0.12
STRICT = 0.22
FEW, MANY = 100, 200
_LETTER = WORD.copy()
_LETTER[list(b"0123456789")] = False
_CHUNK = 1 << 18
_ROWS = 256  # a row takes DIMENSIONS counts


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket and row of every trigram whose first or middle byte is a letter; anything else reads as a blank."""
    rows = len(offsets) - 1
    n = len(data)
    low = fold(data)
    low[~_LETTER[low]] = 32
    padded = np.full(n + 2 * rows + 2, 32, np.uint8)
    shift = np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))
    padded[np.arange(n) + shift] = low
    row = np.repeat(np.arange(rows), np.diff(offsets) + 2)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    a, b, c = (x[: len(row)] for x in (a, b, c))
    ok = b != 32
    code = (a[ok].astype(np.uint32) << 16) | (b[ok].astype(np.uint32) << 8) | c[ok]
    code *= np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    return (code >> np.uint32(20)).astype(np.int64), row[ok], rows


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, a row per document."""
    bucket, row, rows = _grams(data, offsets)
    return np.bincount(row * DIMENSIONS + bucket, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf.astype(np.float32)) * idf.astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    norm[norm == 0] = 1
    return x / norm[:, None]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and the number of documents: one pass over all of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            col = Column(batch.column(0))
            for lo, hi, data, off in col.chunks(_CHUNK, _ROWS):
                tf = counts(data, off)
                df += (tf > 0).sum(0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(df, n))], ["b", "n"])

    rows = pick(docs, "text").mapInArrow(thrifty(partial), "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        out[r["b"]] = r["n"]
    return out[:-1], int(out[-1])


def _sample(docs: DataFrame, size: int) -> dict[str, np.ndarray]:
    """Trigram counts of at most ``size`` labelled documents a language, those whose text has the smallest hashes."""
    flat = pick(docs, "text", "lang").filter("lang is not null and length(text) > 0")
    flat = flat.select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    top = flat.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= size)
    keys = cut(top.select("lang", "h").distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in Column(batch.column(2)).chunks(_CHUNK, _ROWS):
                tf = counts(data, off)
                row, bucket = np.nonzero(tf)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=hi - lo))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (bucket, tf[row, bucket])]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:2]), *lists], ["lang", "h", "bucket", "n"])

    # the rows joined are bounded by the sample; only they reach the driver, as counts
    found = flat.join(sized(keys), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "h", "text")
    rows = found.mapInArrow(thrifty(count), "lang string, h bigint, bucket array<int>, n array<int>").collect()
    out: dict[str, list[np.ndarray]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        tf = np.zeros(DIMENSIONS, np.int64)
        tf[r["bucket"]] = r["n"]
        out.setdefault(r["lang"], []).append(tf)
    return {lang: np.stack(tfs) for lang, tfs in out.items()}


class Model:
    """Centroids (k, D), the language of each, IDF, the expected cosine by number of n-grams and the limit for many n-grams."""

    def __init__(self, centroids: np.ndarray, languages: list[str], idf: np.ndarray, a: float, c: float, strict: float = STRICT):
        self.centroids, self.languages, self.idf, self.a, self.c, self.strict = centroids, languages, idf, a, c, strict

    def limit(self, tf: np.ndarray) -> np.ndarray:
        """The score that each row must reach."""
        return np.interp(np.count_nonzero(tf, axis=1), (FEW, MANY), (ACCEPT, self.strict))

    def score(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest centroid and the length-corrected cosine."""
        n = tf.sum(1)
        if not len(self.centroids):
            return np.zeros(len(tf), int), np.zeros(len(tf))
        cos = vectors(tf, self.idf) @ self.centroids.T
        best = cos.argmax(1)
        top = cos[np.arange(len(tf)), best].astype(np.float64)
        expected = self.a * np.sqrt(n / (n + self.c + 1e-9))
        return best, np.where(n > 0, top / np.maximum(expected, 1e-9), 0.0)


def _kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [int((x @ x.mean(0)).argmax())]
    while len(seeds) < min(k, len(x)):
        far = (x @ x[seeds].T).max(1)
        if far.min() > 1 - 1e-6:
            break
        seeds.append(int(far.argmin()))
    c = x[seeds].copy()
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].sum(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(docs: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    languages: list[str] = []
    parts, fitted = [], []
    for lang, tf in _sample(docs, sample).items():
        tf = tf[tf.sum(1) > 0]
        if len(tf):
            c = _kmeans(vectors(tf, idf), k)
            parts.append(c)
            languages += [lang] * len(c)
            fitted.append(tf)
    if not parts:
        return Model(np.zeros((0, DIMENSIONS), np.float32), [], idf, 1.0, 0.0)
    centroids = np.concatenate(parts).astype(np.float32)
    cos = np.concatenate([(vectors(tf, idf) @ centroids.T).max(1) for tf in fitted]).astype(np.float64)
    m = np.concatenate([tf.sum(1) for tf in fitted])
    slope, level = np.polyfit(1 / m, 1 / cos**2, 1, w=cos**2) if len(np.unique(m)) > 1 else (0.0, float(np.mean(1 / cos**2)))
    level = max(level, 1e-3)
    model = Model(centroids, languages, idf, float(level**-0.5), float(max(slope, 0) / level))
    reached = np.concatenate([model.score(tf)[1][np.count_nonzero(tf, axis=1) >= MANY] for tf in fitted])
    if len(reached):
        model.strict = max(STRICT, 0.4 * float(np.quantile(reached, 0.01)))
    return model


def _labeller(model: Model, text_at: int, accept: float | None):
    names = np.array([*model.languages, None], dtype=object)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            col = Column(batch.column(text_at))
            best = np.full(len(col), len(names) - 1)
            score = np.zeros(len(col))
            for lo, hi, data, off in col.chunks(_CHUNK, _ROWS):
                tf = counts(data, off)
                b, s = model.score(tf)
                score[lo:hi] = s
                best[lo:hi] = np.where(s >= (model.limit(tf) if accept is None else accept), b, len(names) - 1) if model.languages else len(names) - 1
            yield batch, names[best], score

    return label


def identify(docs: DataFrame, model: Model | None = None, accept: float | None = None) -> DataFrame:
    """``(doc_id, predicted, score)`` for every document; ``predicted`` is null where it is rejected. ``accept``: one limit for all."""
    label = _labeller(model or fit(docs), 1, accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, score in label(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "predicted", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(thrifty(run), f"doc_id {kind(docs, 'doc_id')}, predicted string, score double")


def keep_identified(docs: DataFrame, model: Model | None = None, accept: float | None = None) -> DataFrame:
    """The documents that aren't rejected, all columns as they are."""
    flat, at = positional(docs), place(docs, "text")
    label = _labeller(model or fit(docs), at, accept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, _ in label(batches):
            yield batch.filter(pa.array([x is not None for x in lang], pa.bool_()))

    return flat.mapInArrow(thrifty(run), flat.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
