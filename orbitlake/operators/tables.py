"""Joins, normalisation and accuracy over small property tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.physics import finite, normalized, normalized_error


def strict_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails when a left row has no partner."""
    marked = right.withColumn("_hit", F.lit(True))
    joined = left.join(marked, on, "left")
    check = F.when(F.col("_hit").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no partner for"), *[F.col(c).cast("string") for c in on]))).otherwise(F.col("_hit"))
    return joined.withColumn("_hit", check).filter("_hit").drop("_hit")


def rounded_join(left: DataFrame, right: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Equi-join on a float key rounded half to even."""
    scale = 10**digits
    at = lambda df: df.withColumn("_k", F.rint(F.col(key) * scale).cast("bigint"))
    return at(left).join(at(right).drop(key), "_k").drop("_k")


def dimension(facts: DataFrame, dim: DataFrame, on: str, value: str) -> DataFrame:
    """Look a value up; a key that the dimension lacks is an error."""
    joined = facts.join(dim.select(on, value), on, "left")
    return joined.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))).otherwise(F.col(value)))


def endpoint_normalize(df: DataFrame, endpoints: DataFrame, by: list[str], raw: str, err: str, n: str, x_b: str) -> DataFrame:
    """``norm`` and ``norm_err`` against the pure endpoints ``(by…, e_fe, e_b, err_fe, err_b)`` of each state."""
    joined = df.join(endpoints, by)
    c = F.col
    return joined.withColumns({
        "norm": normalized(c(raw), c(n), c(x_b), c("e_b"), c("e_fe")),
        "norm_err": normalized_error(c(err), c(n), c(x_b), c("err_b"), c("err_fe")),
    })


def numeric_pairs(df: DataFrame, first: Column, second: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose two texts are numbers ``(a, b)``, and the counts ``(kept, dropped)``. NaN text is a number."""
    both = df.select(first.try_cast("double").alias("a"), second.try_cast("double").alias("b"))
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    return both.filter(ok), both.agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("dropped"))


def parity(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """RMSE, MAE and n over finite pairs, by one partial aggregation."""
    d = F.col(predicted) - F.col(true)
    rows = df.filter(finite(F.col(true)) & finite(F.col(predicted)))
    return rows.agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n"))


def axis_limits(df: DataFrame, columns: list[str], share: float = 0.05) -> DataFrame:
    """Common limits of several columns with a margin; 1 where all values are equal."""
    lo = F.min(F.least(*columns)) if len(columns) > 1 else F.min(columns[0])
    hi = F.max(F.greatest(*columns)) if len(columns) > 1 else F.max(columns[0])
    out = df.agg(lo.alias("lo"), hi.alias("hi"))
    margin = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * share).otherwise(1.0)
    return out.select((F.col("lo") - margin).alias("lo"), (F.col("hi") + margin).alias("hi"))


def grid_of(*dims: DataFrame) -> DataFrame:
    """Cartesian product of dimension tables."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out


def zip_arrays(df: DataFrame, left: str, right: str) -> DataFrame:
    """Element pairs of two arrays by position; rows of unequal lengths are left out."""
    same = df.filter(F.size(left) == F.size(right))
    return same.select(*[c for c in df.columns if c not in (left, right)], F.posexplode(F.arrays_zip(F.col(left).alias("a"), F.col(right).alias("b"))).alias("i", "p")).select("*", "p.a", "p.b").drop("p")


def lists_by(df: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Parallel arrays of each group in order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_r"))
    return rows.select(key, *[F.col(f"_r.{c}").alias(c) for c in (order, *values)])


def bounded_max(df: DataFrame, by: list[str], x: str, y: str, limit: float, factor: float = 1.06) -> DataFrame:
    """The largest finite ``y`` up to ``x`` = ``limit``, times a margin factor."""
    return df.filter((F.col(x) <= limit) & finite(F.col(y))).groupBy(*by).agg((F.max(y) * factor).alias("top"))
