"""Small fits by group: polynomials, their inflections, and the Ornstein–Zernike form. Groups are curves of few points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import GUIDE_X, OZ_KMAX
from ..functions.physics import derivative, horner


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)


def polynomial_fit(df: DataFrame, by: list[str], x: str, y: str, degree: int = 5) -> DataFrame:
    """``(by…, coefficients)``, highest power first, of degree min(``degree``, n - 1), by orthogonal factorisation."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ok = np.isfinite(pdf[x].astype(float)) & np.isfinite(pdf[y].astype(float))
        a, b = pdf[x][ok].to_numpy(float), pdf[y][ok].to_numpy(float)
        c = np.polyfit(a, b, min(degree, len(a) - 1)) if len(a) else None
        return pd.DataFrame({**{k: [v] for k, v in zip(by, key, strict=True)}, "coefficients": [c]})

    return df.select(*by, x, y).groupBy(*by).applyInPandas(run, f"{_keys(df, by)}, coefficients array<double>")


def evaluate(fits: DataFrame, lo: float, hi: float, points: int) -> DataFrame:
    """Fitted curves on an even grid, each point computed from the start."""
    x = F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1))
    grid = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    return grid.withColumn("y", horner(F.col("coefficients"), F.col("x"))).drop("coefficients", "i")


def inflection_of(coefficients, reference: float, lo: float, hi: float, default: float) -> float:
    roots = np.roots(np.polyder(np.asarray(coefficients, float), 2)) if coefficients is not None and len(coefficients) > 3 else np.zeros(0)
    real = np.real(roots[np.abs(np.imag(roots)) < 1e-8])
    inside = real[(real >= lo) & (real <= hi)]
    some = inside if len(inside) else real
    return float(some[np.abs(some - reference).argmin()]) if len(some) else default


def inflection(fits: DataFrame, by: list[str], reference: float = 0.6, lo: float = 0.0, hi: float = 1.0, default: float = 0.6) -> DataFrame:
    """``(by…, x_inflection)``: the real root of p″ nearest to the reference, in [lo, hi] if one is there, else ``default``."""

    def run(batches):
        for pdf in batches:
            yield pdf[by].assign(x_inflection=[inflection_of(c, reference, lo, hi, default) for c in pdf["coefficients"]])

    return fits.mapInPandas(run, f"{_keys(fits, by)}, x_inflection double")


def regions(curve: DataFrame, inflections: DataFrame, by: list[str], single: Column | None = None) -> DataFrame:
    """Label curve points before and after the inflection (the point itself belongs to the first part).

    Groups for which ``single`` holds are one convex region.
    """
    joined = curve.join(inflections, by)
    if single is not None:
        joined = joined.withColumn("x_inflection", F.when(single, F.lit(float("inf"))).otherwise(F.col("x_inflection")))
    return joined.withColumn("region", F.when(F.col("x") <= F.col("x_inflection"), "convex").otherwise("concave"))


def slope_at(fits: DataFrame, x: float) -> DataFrame:
    return fits.withColumn("slope", horner(derivative(F.col("coefficients")), F.lit(x)))


def guide_values(fits: DataFrame, points: Sequence[float] = GUIDE_X) -> DataFrame:
    """Fitted curves at single points: ``x, y`` instead of ``coefficients``."""
    at = fits.withColumn("x", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    return at.withColumn("y", horner(F.col("coefficients"), F.col("x"))).drop("coefficients")


def panel(df: DataFrame, by: list[str], x: str, y: str, lo: float = 0.1, hi: float = 0.9, points: int = 300, degree: int = 5, margin: float = 0.01) -> DataFrame:
    """``(by…, coefficients, x_inflection, baseline, ymax)`` of a figure's curves: the fit, its inflection within the data
    (else nearest to 0.6), the lowest of data and curve less a margin, and the highest."""
    fit = polynomial_fit(df, by, x, y, degree)
    data = df.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.min(y).alias("_min"), F.max(y).alias("_max"))
    curve = evaluate(fit, lo, hi, points).groupBy(*by).agg(F.min("y").alias("_cmin"), F.max("y").alias("_cmax"))
    both = fit.join(data, by).join(curve, by)

    def run(batches):
        for pdf in batches:
            at = [inflection_of(c, 0.6, a, b, 0.6) for c, a, b in zip(pdf["coefficients"], pdf["_lo"], pdf["_hi"], strict=True)]
            yield pdf[by].assign(x_inflection=at)

    bent = both.select(*by, "coefficients", "_lo", "_hi").mapInPandas(run, f"{_keys(both, by)}, x_inflection double")
    return both.join(bent, by).select(*by, "coefficients", "x_inflection", (F.least("_min", "_cmin") - margin).alias("baseline"), F.greatest("_max", "_cmax").alias("ymax"))


def endpoints(df: DataFrame, by: list[str], raw: str, atoms: str, x: str, normalized: str) -> DataFrame:
    """``(by…, e_a, e_b)``: the pure ends that normalised ``raw/atoms``, by least squares of the difference on (1 - x) and x."""
    d, one, two = F.col(raw) / F.col(atoms) - F.col(normalized), 1 - F.col(x), F.col(x)
    sums = df.groupBy(*by).agg(*[F.sum(a * b).alias(n) for n, a, b in (("aa", one, one), ("ab", one, two), ("bb", two, two), ("ad", one, d), ("bd", two, d))])
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    e_a, e_b = (F.when(det != 0, (F.col(p) * F.col(q) - F.col("ab") * F.col(r)) / det) for p, q, r in (("bb", "ad", "bd"), ("aa", "bd", "ad")))
    return sums.select(*by, e_a.alias("e_a"), e_b.alias("e_b"))


def oz_parameters(k: np.ndarray, s: np.ndarray, w: np.ndarray, k_max: float = OZ_KMAX) -> tuple[float, float]:
    """Weighted least squares of a/(1 + b k²) with a, b ≥ 0: a in closed form, b by golden sections over log b and 0."""
    ok = np.isfinite(s) & (s > 0) & (np.abs(k) < k_max) & np.isfinite(w)
    k, s, w = k[ok], s[ok], w[ok]
    if len(k) < 3:
        return float("nan"), float("nan")

    def at(b: float) -> tuple[float, float]:
        f = w / (1 + b * k * k)
        a = max(float((f * w * s).sum() / (f * f).sum()), 0.0)
        return a, float(((a * f - w * s) ** 2).sum())

    grid = np.linspace(-8, 8, 161)
    cost = [at(10**t)[1] for t in grid]
    i = int(np.argmin(cost))
    lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)]
    ratio = (5**0.5 - 1) / 2
    for _ in range(80):
        p, q = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, q) if at(10**p)[1] <= at(10**q)[1] else (p, hi)
    b = 10 ** ((lo + hi) / 2)
    if at(0.0)[1] <= at(b)[1]:
        b = 0.0
    return at(b)[0], float(b)


def oz_fit(df: DataFrame, by: list[str], k: str = "k", s: str = "scc", w: str | None = None, k_max: float = OZ_KMAX) -> DataFrame:
    """``(by…, a, b)``: the intercept a = S(0); null with fewer than three usable points, ``a`` null unless positive."""
    rows = df.select(*by, F.col(k).alias("k"), F.col(s).alias("s"), (F.col(w) if w else F.lit(1.0)).alias("w"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = oz_parameters(*(pdf[c].to_numpy(float) for c in ("k", "s", "w")), k_max)
        good = np.isfinite(a)
        return pd.DataFrame({**{n: [v] for n, v in zip(by, key, strict=True)}, "a": [a if good and a > 0 else None], "b": [b if good else None]}).astype({"a": "float64", "b": "float64"})

    return rows.groupBy(*by).applyInPandas(run, f"{_keys(df, by)}, a double, b double").withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("a", "b")})


def oz_curve(fits: DataFrame, k_points: DataFrame) -> DataFrame:
    return fits.crossJoin(F.broadcast(k_points)).withColumn("s_fit", F.col("a") / (1 + F.col("b") * F.col("k") * F.col("k")))


#: Named fits of S_cc(0), for callers that choose by name.
METHODS: dict[str, Callable] = {"oz_direct": oz_fit}
