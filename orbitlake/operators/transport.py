"""Collective transport: centre-of-mass frame, lag correlations, Onsager coefficients.

``atoms``: ``run, frame_idx, atom_id, species, mass, xu, yu, zu`` (unwrapped, Å).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import A2_PS_TO_CM2_S, A3_TO_CM3, KB

_AXES = ("xu", "yu", "zu")
_CELLS = 1 << 21


def centered(atoms: DataFrame, columns: tuple[str, ...] = _AXES) -> DataFrame:
    """Subtract each frame's mass-weighted mean."""
    m = F.sum("mass")
    com = atoms.groupBy("run", "frame_idx").agg(*[(F.sum(F.col("mass") * F.col(c)) / m).alias(f"_{c}") for c in columns])
    return atoms.join(com, ["run", "frame_idx"]).withColumns({c: F.col(c) - F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def lag_table(frames: DataFrame, fraction: float = 0.5, stride: int = 1) -> DataFrame:
    """``(run, lag)``: multiples of the stride up to max(2, ⌊(n-1)·fraction⌋); all lags if that leaves fewer than two."""
    n = frames.groupBy("run").agg(F.count_distinct("frame_idx").alias("n"))
    top = F.greatest(F.lit(2), F.floor((F.col("n") - 1) * fraction)).cast("int")
    few = (top / stride).cast("int") < 2
    some = F.when(few, F.sequence(F.lit(1), F.greatest(F.col("n").cast("int") - 1, F.lit(1)))).otherwise(F.sequence(F.lit(stride), F.greatest(top, F.lit(stride)), F.lit(stride)))
    return n.select("run", "n", F.explode(some).alias("lag")).filter("lag < n").select("run", "lag")


def collective(atoms: DataFrame) -> DataFrame:
    """Sum of positions of each species in each frame."""
    return atoms.groupBy("run", "frame_idx", "species").agg(*[F.sum(c).alias(c) for c in _AXES])


def _shifted(rows: DataFrame, lags: DataFrame, keys: list[str], origin_stride: int) -> DataFrame:
    """Displacements over every lag from every origin: equi-joins on (run, key, frame)."""
    start = rows.filter(F.col("frame_idx") % origin_stride == 0).join(lags, "run").withColumn("_t", F.col("frame_idx") + F.col("lag"))
    end = rows.select("run", *keys, F.col("frame_idx").alias("_t"), *[F.col(c).alias(f"_{c}") for c in _AXES])
    both = start.join(end, ["run", *keys, "_t"])
    return both.select("run", *keys, "frame_idx", "lag", *[(F.col(f"_{c}") - F.col(c)).alias(f"d{c[0]}") for c in _AXES])


def correlations(atoms: DataFrame, lags: DataFrame, origin_stride: int = 1) -> DataFrame:
    """``(run, lag, species_a ≤ species_b, c)``: mean over origins of the collective displacements' product."""
    d = _shifted(collective(atoms), lags, ["species"], origin_stride)
    a = d.select("run", "lag", "frame_idx", F.col("species").alias("species_a"), *[F.col(f"d{c}").alias(f"a{c}") for c in "xyz"])
    b = d.select("run", "lag", "frame_idx", F.col("species").alias("species_b"), *[F.col(f"d{c}").alias(f"b{c}") for c in "xyz"])
    dot = F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")
    return a.join(b, ["run", "lag", "frame_idx"]).filter("species_a <= species_b").groupBy("run", "lag", "species_a", "species_b").agg(F.avg(dot).alias("c"))


def _spectra(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """Spectrum of the sum over t of ``u[t] v[t + lag]``, added up over all but the last axis."""
    f = np.conj(np.fft.rfft(u, size)) * np.fft.rfft(v, size)
    return f.reshape(-1, f.shape[-1]).sum(0)


def _size(frames: int) -> int:
    """Room for every lag without wrapping round."""
    return 1 << (2 * frames - 1).bit_length()


def _dense(column: pa.Array, at: np.ndarray, row: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    out[row, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def self_correlations(atoms: DataFrame, lags: DataFrame, origin_stride: int = 1) -> DataFrame:
    """``(run, lag, species, c)``: squared displacements summed over particles, averaged over the origins at which the species is there.

    A particle's series is transformed once, and its sums over all origins at every lag come from products of transforms, so
    the work is that of the atoms times the logarithm of the frames. Missing frames are left out by their masks.
    """
    rows = atoms.groupBy("run", "species", "atom_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", *_AXES))).alias("s"))
    rows = rows.select("run", "species", F.col("s.frame_idx").cast("array<bigint>").alias("t"), *[F.col(f"s.{c}").cast("array<double>").alias(c) for c in _AXES])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [str(k) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for key in sorted(set(keys)):
                mine = np.flatnonzero(np.array(keys) == key)
                n = 1 + max(int(batch.column(2).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).max(initial=0)), 0)
                spectrum, size = 0, _size(n)
                for lo in range(0, len(mine), max(1, _CELLS // size)):
                    some = batch.take(pa.array(mine[lo : lo + max(1, _CELLS // size)]))
                    row = np.repeat(np.arange(some.num_rows), sizes[mine[lo : lo + some.num_rows]])
                    at = some.column(2).flatten().to_numpy(zero_copy_only=False)
                    here = np.zeros((some.num_rows, n))
                    here[row, at] = 1
                    start = here * (np.arange(n) % origin_stride == 0)
                    square = 0
                    for axis in range(3, 6):
                        x = _dense(some.column(axis), at, row, here.shape)
                        x = (x - x.sum(1, keepdims=True) / here.sum(1, keepdims=True)) * here
                        square = square + x * x
                        spectrum = spectrum - 2 * _spectra(start * x, x, size)
                    spectrum = spectrum + _spectra(start * square, here, size) + _spectra(start, square, size)
                c = np.fft.irfft(spectrum, size)[1:n]
                first = pa.array(np.full(n - 1, mine[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), pa.array(np.arange(1, n)), pa.array(c)], ["run", "species", "lag", "c"])

    def origins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = np.array(batch.column(2)[k].as_py())
                here = np.zeros(int(at.max()) + 1)
                here[at] = 1
                size = _size(len(here))
                n = np.rint(np.fft.irfft(_spectra(here * (np.arange(len(here)) % origin_stride == 0), here, size), size))[1 : len(here)].astype(np.int64)
                first = pa.array(np.full(len(n), k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), pa.array(np.arange(1, len(here))), pa.array(n)], ["run", "species", "lag", "n"])

    keys = ", ".join(f"{c} {atoms.schema[c].dataType.simpleString()}" for c in ("run", "species"))
    sums = rows.mapInArrow(total, f"{keys}, lag bigint, c double").groupBy("run", "species", "lag").agg(F.sum("c").alias("c"))
    seen = atoms.groupBy("run", "species").agg(F.collect_set(F.col("frame_idx").cast("bigint")).alias("t"))
    counts = seen.mapInArrow(origins, f"{keys}, lag bigint, n bigint").filter("n > 0")
    wanted = lags.select("run", F.col("lag").cast("bigint").alias("lag"))
    return sums.join(counts, ["run", "species", "lag"]).join(wanted, ["run", "lag"]).select("run", F.col("lag").cast(lags.schema["lag"].dataType).alias("lag"), "species", (F.col("c") / F.col("n")).alias("c"))


def slope_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(by…, slope, r2)`` over finite pairs; null under two points, ``r2`` null where y is constant."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    ok = finite(x) & finite(y)
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    out = df.groupBy(*by).agg(F.regr_slope(b, a).alias("slope"), F.regr_r2(b, a).alias("r2"), F.var_pop(b).alias("_v"), F.count(b).alias("_n"))
    enough = F.col("_n") >= 2
    return out.select(*by, F.when(enough, F.col("slope")).alias("slope"), F.when(enough & (F.col("_v") > 0), F.col("r2")).alias("r2"))


def fit_window(t_max: Column, start: float | None = None, end: float | None = None) -> tuple[Column, Column]:
    """20–80 % of the longest time by default; an empty window is an error."""
    lo = t_max * 0.2 if start is None else F.lit(start)
    hi = t_max * 0.8 if end is None else F.lit(end)
    return lo, F.when(hi > lo, hi).otherwise(F.raise_error(F.lit("the fit window is empty")))


def onsager(atoms: DataFrame, temperature: float, mean_volume: float, dt_ps: float, **options) -> DataFrame:
    """``onsager_by_run`` with one state for all runs."""
    state = {"temperature": F.lit(float(temperature)), "volume": F.lit(float(mean_volume)), "dt_ps": F.lit(float(dt_ps))}
    return onsager_by_run(atoms, atoms.select("run").distinct().withColumns(state), **options)


def onsager_by_run(atoms: DataFrame, runs: DataFrame, fraction: float = 0.5, stride: int = 1, origin_stride: int = 1, start: float | None = None, end: float | None = None) -> DataFrame:
    """``(run, species_a, species_b, l, r2, l_self, d_self, r2_self, factor)`` in the centre-of-mass frame.

    ``runs(run, temperature, volume, dt_ps)``. The self columns are on the diagonal only.
    """
    rows = centered(atoms)
    lags = lag_table(rows, fraction, stride)
    state = runs.join(lags.groupBy("run").agg(F.max("lag").alias("m")), "run").withColumn("t_max", F.col("m") * F.col("dt_ps"))
    lo, hi = fit_window(F.col("t_max"), start, end)

    def fitted(corr: DataFrame, keys: list[str]) -> DataFrame:
        timed = corr.join(state, "run").withColumn("t", F.col("lag") * F.col("dt_ps")).filter((F.col("t") >= lo) & (F.col("t") <= hi))
        return slope_fit(timed, ["run", *keys], "t", "c")

    volume = F.col("volume") * A3_TO_CM3
    kt = F.lit(KB) * F.col("temperature")
    scale = F.lit(A2_PS_TO_CM2_S) / (6 * kt * volume)
    full = fitted(correlations(rows, lags, origin_stride), ["species_a", "species_b"]).join(runs, "run")
    full = full.select("run", "species_a", "species_b", (F.col("slope") * scale).alias("l"), "r2")
    number = rows.groupBy("run", "species").agg(F.count_distinct("atom_id").alias("n"))
    own = fitted(self_correlations(rows, lags, origin_stride), ["species"]).join(number, ["run", "species"]).join(runs, "run")
    own = own.select("run", F.col("species").alias("species_a"), F.col("species").alias("species_b"), (F.col("slope") * scale).alias("l_self"), (F.col("slope") * scale * kt / (F.col("n") / volume)).alias("d_self"), F.col("r2").alias("r2_self"))
    out = full.join(own, ["run", "species_a", "species_b"], "left")
    return out.withColumn("factor", F.when(F.col("l_self") != 0, F.col("l") / F.col("l_self") - 1)).select("run", "species_a", "species_b", "l", "r2", "l_self", "d_self", "r2_self", "factor")
