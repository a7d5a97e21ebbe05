"""Order-dependent operators over series: ordinals, blocks, windows, integrals, segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def ordinal(df: DataFrame, by: Keys, order: Sequence, name: str = "ordinal") -> DataFrame:
    """Add the 0-based position within the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def skip_stride(df: DataFrame, by: Keys, order: Sequence, skip: int = 0, stride: int = 1, most: int | None = None) -> DataFrame:
    """Rows from position ``skip`` on, every ``stride``-th, at most ``most`` a group."""
    at = F.col("ordinal") - skip
    out = ordinal(df, by, order).filter((at >= 0) & (at % stride == 0))
    return out if most is None else out.filter(at < stride * most)


def last_fraction(df: DataFrame, by: Keys, order: Sequence, lo: float, hi: float, stride: int = 1, most: int | None = None) -> DataFrame:
    """Strided rows whose position lies in [rint(lo·n), rint(hi·n)), then the first ``most``."""
    w = Window.partitionBy(*by)
    out = skip_stride(df, by, order, 0, stride).withColumn("ordinal", (F.col("ordinal") / stride).cast("int"))
    n = F.count("*").over(w)
    first = F.rint(F.lit(float(lo)) * n)
    keep = (F.col("ordinal") >= first) & (F.col("ordinal") < F.rint(F.lit(float(hi)) * n))
    if most is not None:
        keep &= F.col("ordinal") < first + most
    return out.withColumn("_keep", keep).filter("_keep").drop("_keep")


def block_average(df: DataFrame, by: Keys, order: Sequence, value: str, skip: int, block: int) -> DataFrame:
    """``(by…, mean, err, n, n_blocks)``: mean of all rows after the skip; error from the full blocks' means.

    Rows without a value don't count (ordinals are per series). Fewer than two full blocks
    give a null error; a group with nothing after the skip is absent.
    """
    rows = ordinal(df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), by, order).filter(F.col("ordinal") >= skip)
    each = rows.groupBy(*by, F.floor((F.col("ordinal") - skip) / block).alias("_b")).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    full = F.col("_n") == block
    out = each.groupBy(*by).agg(
        (F.sum("_s") / F.sum("_n")).alias("mean"),
        F.stddev_samp(F.when(full, F.col("_s") / F.col("_n"))).alias("_e"),
        F.sum("_n").alias("n"),
        F.count_if(full).alias("n_blocks"),
    )
    err = F.when(F.col("n_blocks") >= 2, F.col("_e") / F.sqrt(F.col("n_blocks")))
    return out.select(*by, "mean", err.alias("err"), "n", "n_blocks")


def cumulative_trapezoid(df: DataFrame, by: Keys, order: Sequence, value: Column, step: Column, name: str) -> DataFrame:
    """Running integral on an even grid: cumsum(I)·d - d/2·(I₀ + I)."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(run) * step - 0.5 * step * (F.first(value).over(run) + value))


def trapezoid(df: DataFrame, by: Keys, x: str, values: dict[str, Column]) -> DataFrame:
    """Definite integrals over ``x`` of several columns: one row a group."""
    w = Window.partitionBy(*by).orderBy(x)
    made = df.select(*by, F.col(x).alias("_x"), *[v.alias(f"_{n}") for n, v in values.items()], F.lag(x).over(w).alias("_px"), *[F.lag(v).over(w).alias(f"_p{n}") for n, v in values.items()])
    part = lambda n: F.sum((F.col("_x") - F.col("_px")) * (F.col(f"_{n}") + F.col(f"_p{n}")) / 2)
    return made.groupBy(*by).agg(*[F.coalesce(part(n), F.lit(0.0)).alias(n) for n in values])


def frame_spacing(df: DataFrame, by: Keys, order: str) -> DataFrame:
    """Median difference of consecutive steps, rounded half to even."""
    d = F.col(order) - F.lag(order).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_d", d).filter("_d is not null").groupBy(*by).agg(F.rint(F.median("_d")).cast("bigint").alias("spacing"))


def sign_segments(df: DataFrame, by: Keys, order: str, value: str) -> DataFrame:
    """Maximal runs of one sign (0 is a sign of its own): bounds, length, sign and the value's sign at the middle row."""
    w = Window.partitionBy(*by).orderBy(order)
    sign = F.signum(F.col(value).cast("double")).cast("int")
    flagged = df.withColumn("_g", sign).withColumn("_n", F.coalesce((F.lag("_g").over(w) != F.col("_g")).cast("int"), F.lit(0)))
    runs = flagged.withColumn("segment", F.sum("_n").over(w))
    return runs.groupBy(*by, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.first("_g").alias("sign"))


def transitions(df: DataFrame, by: Keys, order: Sequence, value: str, name: str = "type_id") -> DataFrame:
    """1 plus the number of changes of ``value`` so far."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1)).cast("int"), F.lit(0))
    return df.withColumn("_c", change).withColumn(name, F.sum("_c").over(w) + 1).drop("_c")


def thin_beyond(df: DataFrame, by: Keys, order: str, limit: float, every: int) -> DataFrame:
    """All rows up to the limit, and every ``every``-th of the rest."""
    beyond = F.col(order) > limit
    w = Window.partitionBy(*by, beyond).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w) - 1).filter(~beyond | (F.col("_r") % every == 0)).drop("_r")


def last_write(df: DataFrame, key: Keys, order: str) -> DataFrame:
    """The last row of each key, by partial aggregation: no sort of the input."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_v"))
    return best.select(*key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def nearest(df: DataFrame, by: Keys, x: str, target: float, order: str) -> DataFrame:
    """The row of each group nearest to the target; the first on a tie."""
    best = F.min_by(F.struct(*df.columns), F.struct(F.abs(F.col(x) - target), F.col(order)))
    return df.groupBy(*by).agg(best.alias("_v")).select("_v.*")


def nearest_frames(df: DataFrame, by: Keys, frame: str, time: str, count: int, spacing: float) -> DataFrame:
    """From the last frame backwards, ``count`` frames ``spacing`` apart, each the nearest unused earlier one.

    Each choice restricts the next, so a group is worked through in sequence. A group that
    can't give ``count`` frames is absent.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame, kind="stable")
        t, at = pdf[time].to_numpy(float), pdf[frame].to_numpy()
        picks, end = [], len(t)
        for i in range(count):
            if end <= 0:
                break
            goal = t[-1] - i * spacing
            end = int(np.abs(t[:end] - goal).argmin())
            picks.append((i, goal, end))
        rows = [(*key, i, g, at[p], t[p]) for i, g, p in picks] if len(picks) == count else []
        return pd.DataFrame(rows, columns=[*by, "rank", "target", "frame", "time"])

    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{keys}, rank int, target double, frame {df.schema[frame].dataType.simpleString()}, time double"
    return df.groupBy(*by).applyInPandas(run, schema)
