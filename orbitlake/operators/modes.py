"""Structure factors in reciprocal space. ``atoms`` as in ``pairs``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.physics import concentration_structure


def k_grid(spark: SparkSession, shells: int) -> DataFrame:
    """The (2·shells+1)³ - 1 integer vectors other than 0: its size depends on ``shells`` alone."""
    axis = lambda n: spark.range(-shells, shells + 1).select(F.col("id").cast("double").alias(n))
    return axis("nx").crossJoin(axis("ny")).crossJoin(axis("nz")).filter("nx*nx + ny*ny + nz*nz > 0")


def density_modes(atoms: DataFrame, shells: int) -> DataFrame:
    """``(frame, nx, ny, nz, species, re, im, v)``: ρ(k) = Σ exp(-2πi n·s) of each species in each frame.

    The grid is broadcast (its size is fixed); sums are combined before the shuffle.
    """
    s = atoms.select("frame", "species", *[(F.col(c) / F.col(f"l{c}")).alias(f"s{c}") for c in "xyz"], (F.col("lx") * F.col("ly") * F.col("lz")).alias("v"))
    phase = F.lit(2 * math.pi) * (F.col("nx") * F.col("sx") + F.col("ny") * F.col("sy") + F.col("nz") * F.col("sz"))
    out = s.crossJoin(F.broadcast(k_grid(atoms.sparkSession, shells))).withColumn("p", phase)
    return out.groupBy("frame", "nx", "ny", "nz", "species").agg(F.sum(F.cos("p")).alias("re"), (-F.sum(F.sin("p"))).alias("im"), F.first("v").alias("v"))


def partial_structure(modes: DataFrame, fe, b) -> DataFrame:
    """``(nx, ny, nz, s_ff, s_fb, s_bb)``: real part of ⟨ρρ*⟩/V, averaged over frames. A species without particles counts 0."""
    def of(which, c):
        return F.coalesce(F.sum(F.when(F.col("species") == which, F.col(c))), F.lit(0.0))

    frames = modes.groupBy("frame", "nx", "ny", "nz").agg(of(fe, "re").alias("fr"), of(fe, "im").alias("fi"), of(b, "re").alias("br"), of(b, "im").alias("bi"), F.first("v").alias("v"))
    return frames.groupBy("nx", "ny", "nz").agg(
        F.avg((F.col("fr") * F.col("fr") + F.col("fi") * F.col("fi")) / F.col("v")).alias("s_ff"),
        F.avg((F.col("fr") * F.col("br") + F.col("fi") * F.col("bi")) / F.col("v")).alias("s_fb"),
        F.avg((F.col("br") * F.col("br") + F.col("bi") * F.col("bi")) / F.col("v")).alias("s_bb"),
    )


def shell_average(partial: DataFrame, box: tuple[float, float, float], x_fe: float, rho: float) -> DataFrame:
    """Averages over the vectors of equal |k| (two digits): ``(k, s_ff, s_fb, s_bb, scc, w)`` with w = √multiplicity. NaN is left out."""
    q = [F.col(f"n{c}") * F.lit(2 * math.pi / length) for c, length in zip("xyz", box, strict=True)]
    k = F.rint(F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2]) * 100) / 100
    scc = concentration_structure(F.col("s_ff"), F.col("s_fb"), F.col("s_bb"), F.lit(x_fe), F.lit(rho))
    rows = partial.withColumn("k", k).withColumn("scc", scc)
    mean = [F.avg(F.nullif(F.col(c), F.lit(float("nan")))).alias(c) for c in ("s_ff", "s_fb", "s_bb", "scc")]
    return rows.groupBy("k").agg(*mean, F.sqrt(F.count("*")).alias("w"))


def reciprocal_structure(atoms: DataFrame, fe, b, box: tuple[float, float, float], x_fe: float, rho: float, shells: int = 4) -> DataFrame:
    """Trajectory → S_cc(k): modes, products, projection, shells."""
    return shell_average(partial_structure(density_modes(atoms, shells), fe, b), box, x_fe, rho)
