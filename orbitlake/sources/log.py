"""Thermo logs: sections of numeric rows under a header that names ``Step`` and one of the known quantities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import pv
from .bundles import read_texts
from .dump import run_of

#: Column of the result and the header spellings (lower case, without underscores).
ALIASES = {"pe": ("poteng", "pe"), "ke": ("kineng", "ke"), "press": ("press", "pressure"), "vol": ("volume", "vol"), "temp": ("temp",)}
_KNOWN = {s for spellings in ALIASES.values() for s in spellings}
_END = ("Loop time", "WARNING", "ERROR")
_SCHEMA = "run string, row_idx long, step double, pe double, ke double, press double, vol double, temp double"
_ROWS = 50_000  # of a batch to Spark, but for the rows of the last text


def number(text: str) -> float | None:
    """A float, Fortran exponents allowed; None if it isn't one."""
    for plain in (True, False):
        try:
            return float(text if plain else re.sub("[Dd]", "E", text))
        except ValueError:
            pass
    return None


def _rows(lines: list[str]) -> Iterator[tuple]:
    at: dict[str, int] | None = None
    for line in (raw.strip() for raw in lines):
        parts = line.split()
        names = [p.lower().replace("_", "") for p in parts]
        if "step" in names and _KNOWN & {*names}:
            at = {n: i for i, n in enumerate(names)}
        elif line.startswith(_END):
            at = None
        elif at is not None and parts and number(parts[0]) is not None:
            found = []
            for spellings in ALIASES.values():
                i = next((at[s] for s in spellings if s in at), None)
                found.append(number(parts[i]) if i is not None and i < len(parts) else None)
            yield (number(parts[at["step"]]) if at["step"] < len(parts) else None, *found)


def read_log(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """``(run, row_idx, step, pe, ke, press, vol, temp)``: a value that can't be read is null, so each series keeps its own ordinals.

    Section state runs through a file (or member of a bundle) in order, so a file is one task; files run side by side.
    """
    texts = read_texts(spark, path, bundled)
    files = texts.select(run_of(F.col("path")).alias("run"), "value")

    names = ["run", "row_idx", "step", *ALIASES]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), *[pa.float64()] * (1 + len(ALIASES))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(name, i, *r) for i, r in enumerate(_rows(text.as_py().splitlines()))]
                if len(rows) >= _ROWS:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    got = files.mapInArrow(run, _SCHEMA)
    return got.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("step", *ALIASES)})


def with_energies(log: DataFrame) -> DataFrame:
    """Add P·V and the enthalpy; null where a part is."""
    work = pv(F.col("press"), F.col("vol"))
    return log.withColumn("pv", work).withColumn("enthalpy", F.col("pe") + F.col("ke") + work)
