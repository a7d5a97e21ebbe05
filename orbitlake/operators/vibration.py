"""Vibrational density of states and the thermodynamics of independent oscillators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import KB, PLANCK
from .series import trapezoid


def spectrum(atoms: DataFrame, dt_s: float, hann: bool = True) -> DataFrame:
    """``(run, bin, e_ev, vdos)`` of unit area from ``atoms(run, frame_idx, atom_id, mass, vx, vy, vz)``.

    Series are gathered by particle and transformed in batches; averages, one-sided scaling
    and normalisation are relational. A run's particles must cover the same frames.
    """
    kind = atoms.schema["run"].dataType.simpleString()
    step = F.array_sort(F.collect_list(F.struct("frame_idx", *[F.col(c).cast("double").alias(c) for c in ("vx", "vy", "vz")])))
    series = atoms.groupBy("run", "atom_id").agg(F.first(F.col("mass").cast("double")).alias("mass"), step.alias("s"))
    series = series.select("run", "mass", *[F.col(f"s.{c}").alias(c) for c in ("vx", "vy", "vz")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(2)))
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                w = np.hanning(n) if hann else np.ones(n)
                power = np.zeros((part.num_rows, n // 2 + 1))
                for c in (2, 3, 4):
                    v = part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    power += np.abs(np.fft.rfft(v * w, axis=1)) ** 2
                power *= part.column(1).to_numpy(zero_copy_only=False)[:, None]
                row = np.repeat(np.arange(part.num_rows), power.shape[1])
                bins = np.tile(np.arange(power.shape[1], dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(bins), pa.array(power.ravel()), pa.array(np.full(len(row), n, np.int32))], ["run", "bin", "p", "n"])

    power = series.mapInArrow(run, f"run {kind}, bin int, p double, n int")
    mean = power.groupBy("run", "bin").agg(F.avg("p").alias("p"), F.first("n").alias("n"))
    last = F.floor(F.col("n") / 2)
    inner = (F.col("bin") > 0) & ((F.col("n") % 2 == 1) | (F.col("bin") < last))
    e = F.col("bin") / (F.col("n") * dt_s) * PLANCK
    s = mean.select("run", "bin", e.alias("e_ev"), (F.col("p") / F.col("n") * dt_s * F.when(inner, 2.0).otherwise(1.0) / PLANCK).alias("s"))
    w = Window.partitionBy("run").orderBy("bin")
    part = (F.col("e_ev") - F.lag("e_ev").over(w)) * (F.col("s") + F.lag("s").over(w)) / 2
    area = F.sum("_a").over(Window.partitionBy("run"))
    return s.withColumn("_a", part).withColumn("_t", area).select("run", "bin", "e_ev", F.when(F.col("_t") > 0, F.col("s") / F.col("_t")).otherwise(F.col("s")).alias("vdos"))


def total_spectrum(vdos: DataFrame, n_atoms: DataFrame) -> DataFrame:
    """Scale to area 3N; ``n_atoms(run, n)``."""
    return vdos.join(n_atoms, "run").withColumn("vdos", F.col("vdos") * 3 * F.col("n")).drop("n")


def _thermo(vdos: DataFrame, temperature: Column) -> DataFrame:
    kt = F.lit(KB) * temperature
    e = F.greatest(F.col("e_ev"), F.lit(1e-12))
    x = F.least(F.greatest(e / kt, F.lit(1e-12)), F.lit(1e3))
    log_term = F.ln(-F.expm1(-x))
    bose = 1 / F.expm1(x)
    g = F.col("vdos")
    # ln(2 sinh(x/2)) in a form that doesn't overflow
    return trapezoid(
        vdos,
        ["run"],
        "e_ev",
        {
            "integral_g": g,
            "i_ln2sinh": (x / 2 + log_term) * g,
            "f_ev": (0.5 * e + kt * log_term) * g,
            "u_ev": (0.5 * e + e * bose) * g,
            "s_ev_k": KB * (x * bose - log_term) * g,
        },
    )


def vibrational_thermo(vdos: DataFrame, temperature: float) -> DataFrame:
    """Harmonic F, U and S of each run from ``(run, e_ev, vdos)``, with both forms of F and the identity's residue."""
    if temperature <= 0:
        raise ValueError("the temperature must be positive")
    out = _thermo(vdos, F.lit(float(temperature)))
    return out.select(
        "run", "integral_g", "i_ln2sinh", (F.col("i_ln2sinh") * (KB * temperature)).alias("f_via_sinh_ev"), "f_ev", "u_ev", "s_ev_k",
        (F.col("s_ev_k") / KB).alias("s_kb"), (F.col("s_ev_k") - (F.col("u_ev") - F.col("f_ev")) / temperature).alias("consistency"),
    )


def entropy_by_run(vdos: DataFrame) -> DataFrame:
    """``(run, s_ev_k)`` from ``(run, e_ev, vdos, temperature)``; runs that aren't above 0 K are absent."""
    return _thermo(vdos.filter("temperature > 0"), F.col("temperature")).select("run", "s_ev_k")
