"""Session helpers: scratch tables on the shared folder, positional columns, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size of a side that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 32
#: Size of the Arrow batches in which texts go to Python workers and back.
ARROW_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where the setting is absent (single-machine runs and tests) a temporary folder is
    chosen and recorded; on a cluster its absence is an error, as executors can't share
    a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orbitlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    folder = f"{scratch_root(spark)}/orbitlake/{app}"
    if app not in _made:  # nothing can read them once the driver has ended
        if urlparse(folder).scheme in ("", "file"):
            atexit.register(shutil.rmtree, urlparse(folder).path, ignore_errors=True)
        else:
            fs, p = _hadoop(spark, folder)
            fs.mkdirs(p)
            fs.deleteOnExit(p)
    path = f"{folder}/{uuid.uuid4().hex}"
    _made.setdefault(app, []).append(path)
    return path


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, losing an executor costs nothing.

    The shuffle files of the write go when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark), spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` returned; nothing that is still to be computed may read them."""
    for table in tables:
        spark, path = table.sparkSession, table._scratch
        _delete(spark, path)
        _made[spark.sparkContext.applicationId].remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    if urlparse(path).scheme in ("", "file"):
        shutil.rmtree(urlparse(path).path, ignore_errors=True)
    else:
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def _filesystem(uri: str):
    """(file system, path) of a URI: the local one (None) for file:, otherwise what pyarrow resolves."""
    u = urlparse(uri)
    return (None, u.path) if u.scheme in ("", "file") else pyarrow.fs.FileSystem.from_uri(uri)


def read_file(uri: str) -> bytes:
    fs, path = _filesystem(uri)
    with open(path, "rb") if fs is None else fs.open_input_stream(path) as stream:
        return stream.read()


def write_file(uri: str, data: bytes) -> None:
    """Write a file under a name of its own and rename it, so that a task that runs again leaves the same file."""
    fs, path = _filesystem(uri)
    draft, folder = f"{path}.{uuid.uuid4().hex}.tmp", path.rpartition("/")[0]
    os.makedirs(folder, exist_ok=True) if fs is None else fs.create_dir(folder)
    with open(draft, "wb") if fs is None else fs.open_output_stream(draft) as stream:
        stream.write(data)
    os.replace(draft, path) if fs is None else fs.move(draft, path)


def mark(spark: SparkSession) -> int:
    return len(_made.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, keep: str | None = None) -> None:
    """Delete the scratch tables made after ``mark`` but ``keep``; results that still read them must have been written."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    for path in [p for p in paths[since:] if p != keep]:
        _delete(spark, path)
    paths[since:] = [keep] if keep in paths[since:] else []


def sized(df: DataFrame, size: str | None = None) -> DataFrame:
    """``df``, hinted for broadcast only if its rows take at most ``BROADCAST_BYTES``, else for a shuffled hash join built on it.

    ``size`` is an SQL expression of a row's bytes, by default ``ROW_BYTES`` for a few numbers.
    Give it a written table: it is measured first.
    """
    return F.broadcast(df) if measured(df, size) <= BROADCAST_BYTES else df.hint("shuffle_hash")


def measured(df: DataFrame, size: str | None = None) -> float:
    """Bytes of the rows of ``df``, as ``sized`` counts them."""
    return df.agg(F.sum(F.expr(size or str(ROW_BYTES))).cast("double")).first()[0] or 0


#: Bits of the largest filter of ``sieve``, and bits a key below that.
SIEVE_BITS = 1 << 27
KEY_BITS = 16


def sieve(keys: DataFrame) -> np.ndarray:
    """A bit set of one-column ``keys`` (64-bit hashes): ``sifted`` finds every key in it, and few others."""
    n = 1 << min(SIEVE_BITS.bit_length() - 1, max(6, (KEY_BITS * keys.count()).bit_length()))
    at = F.col(keys.columns[0]).bitwiseAND(F.lit(n - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63 as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(n >> 6, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint64)


def sifted(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def place(df: DataFrame, name: str) -> int:
    """Position of the column ``name``: the exact name first, then ignoring case."""
    names = df.columns
    if name in names:
        return names.index(name)
    for i, other in enumerate(names):
        if other.lower() == name.lower():
            return i
    raise ValueError(f"no column {name!r} among {names}")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns renamed ``_0, _1, …``, so no column name can clash with another.

    All operators begin here, so this is where Arrow batches are bounded by bytes, unless the application has set a bound.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(ARROW_BYTES))
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, whatever else the table holds."""
    at = [place(df, n) for n in names]
    return positional(df).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def kind(df: DataFrame, name: str) -> str:
    return df.schema.fields[place(df, name)].dataType.simpleString()


def thrifty(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving memory back to the system when a task ends (Python workers live on)."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
                if trim is not None:
                    trim(0)

    return wrapped
