"""Kirkwood–Buff integrals of radial distribution functions ``rdf(pair, r, g)`` on an even grid from r = step/2."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PLATEAU_FRACTION
from ..functions.physics import concentration_structure, sinc, window_weight
from .series import cumulative_trapezoid


def _integrand(weight: Column) -> Column:
    r = F.col("r")
    return F.lit(4 * math.pi) * r * r * (F.col("g") - 1) * weight


def _plateau(cutoff: float, fraction: float) -> Column:
    """Rows from the window's lower end to the cutoff (all rows beyond it if the grid ends before)."""
    return (F.col("r") >= cutoff * (1 - fraction)) & (F.col("r") <= cutoff)


def running(rdf: DataFrame, step: float, cutoff: float) -> DataFrame:
    """``rdf`` with the raw and the windowed running integral."""
    out = cumulative_trapezoid(rdf, ["pair"], ["r"], _integrand(F.lit(1.0)), F.lit(step), "raw_run")
    return cumulative_trapezoid(out, ["pair"], ["r"], _integrand(window_weight(F.col("r"), F.lit(cutoff))), F.lit(step), "kv_run")


def integrate_pair(rdf: DataFrame, step: float, cutoff: float, fraction: float = PLATEAU_FRACTION) -> DataFrame:
    """``(pair, g_raw, g_kv, r_plateau, disagreement)``: means over the plateau."""
    rows = running(rdf, step, cutoff).filter(_plateau(cutoff, fraction))
    out = rows.groupBy("pair").agg(F.avg("raw_run").alias("g_raw"), F.avg("kv_run").alias("g_kv"), F.max("r").alias("r_plateau"))
    return out.withColumn("disagreement", F.abs(F.col("g_raw") - F.col("g_kv")) / F.greatest(F.abs("g_kv"), F.lit(1e-12)))


def sinc_plateau(rdf: DataFrame, k_points: DataFrame, step: float, cutoff: float, fraction: float = PLATEAU_FRACTION) -> DataFrame:
    """``(pair, k, g_k)``: windowed integral with sin(kr)/(kr); equals ``g_kv`` at k = 0. ``k_points`` is a fixed grid."""
    both = rdf.crossJoin(F.broadcast(k_points))
    weight = sinc(F.col("k") * F.col("r")) * window_weight(F.col("r"), F.lit(cutoff))
    out = cumulative_trapezoid(both, ["pair", "k"], ["r"], _integrand(weight), F.lit(step), "run")
    return out.filter(_plateau(cutoff, fraction)).groupBy("pair", "k").agg(F.avg("run").alias("g_k"))


def scc_from_integrals(plateau: DataFrame, rho_fe: float, rho_b: float) -> DataFrame:
    """``(k, s_ff, s_fb, s_bb, scc)`` from the plateaus of the pairs ``FeFe``, ``FeB`` and ``BB``."""
    of = lambda p: F.max(F.when(F.col("pair") == p, F.col("g_k")))
    rows = plateau.groupBy("k").agg(of("FeFe").alias("ff"), of("FeB").alias("fb"), of("BB").alias("bb"))
    rows = rows.select("k", (rho_fe + rho_fe**2 * F.col("ff")).alias("s_ff"), (rho_fe * rho_b * F.col("fb")).alias("s_fb"), (rho_b + rho_b**2 * F.col("bb")).alias("s_bb"))
    rho = rho_fe + rho_b
    return rows.withColumn("scc", concentration_structure(F.col("s_ff"), F.col("s_fb"), F.col("s_bb"), F.lit(rho_fe / rho), F.lit(rho)))
