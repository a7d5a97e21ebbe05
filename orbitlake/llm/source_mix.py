"""Mixing sources to target weights (operator 3).

Tokens are aggregated per source; a source's repetition rate is its share of the token
budget over the tokens it has. Each document is emitted ``floor(rate)`` times, plus one
more copy when a uniform number hashed from the seed and ``doc_id`` lies below the
fraction of the rate.

Cases: a null source is a source of its own; a source without any token (null, empty or
blank texts) has rate 1; a null ``doc_id`` hashes as the empty string; rows that repeat a
``doc_id`` get the same number of copies each (there are no other ties); a text of any
length counts all its tokens; an empty table gives an empty table. All input columns are
kept, whatever their names; ``copy_no`` (1, 2, …) is added last, and an input column of
that name, in whatever case, is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, place, positional, sized

TOKEN = r"[^ \t\n\r\f\x0B]+"
#: Production weights: sources that are not named weigh ``OTHER`` each.
WEIGHTS = {"src0": 4.0, "src1": 0.5, "src2": 3.0}
OTHER = 1.0
SEED = "mix-1"


def n_tokens(text: Column) -> Column:
    """Number of whitespace-separated tokens, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: str) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str, float], other: float, budget: int | None) -> DataFrame:
    """``(source, tokens, rate)``, one row a source."""
    i, j = place(docs, "source"), place(docs, "text")
    flat = positional(docs).select(F.col(f"_{i}").cast("string").alias("source"), n_tokens(F.col(f"_{j}")).alias("n"))
    per = flat.groupBy("source").agg(F.sum("n").alias("tokens"))
    weight = F.lit(float(other))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = cut(per.withColumn("weight", weight))
    total = per.agg(F.sum("tokens").alias("t"), F.sum("weight").alias("w"))
    wanted = F.col("t").cast("double") if budget is None else F.lit(float(budget))
    rate = F.when(F.col("tokens") > 0, wanted * F.col("weight") / F.col("w") / F.col("tokens")).otherwise(1.0)
    return per.crossJoin(F.broadcast(total)).select("source", "tokens", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    other: float = OTHER,
    seed: str = SEED,
    budget: int | None = None,
) -> DataFrame:
    """``docs`` repeated to the target weights, with ``copy_no``. ``budget``: tokens wanted, by default those there are."""
    names = [n for n in docs.columns if n.lower() != "copy_no"]
    at = [k for k, n in enumerate(docs.columns) if n.lower() != "copy_no"]
    return _repeated(docs, weights, other, seed, budget).select(*[f"_{k}" for k in at], "_c").toDF(*names, "copy_no")


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` repeated as by ``mix_sources``, with just the columns of ``docs``."""
    return _repeated(docs, **options).select(*[f"_{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def _repeated(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, other: float = OTHER, seed: str = SEED, budget: int | None = None) -> DataFrame:
    """Positional columns and the number of the copy, ``_c``."""
    i, j = place(docs, "source"), place(docs, "doc_id")
    per = sized(cut(rates(docs, weights, other, budget)).select(F.col("source").alias("_s"), F.col("rate").alias("_r")))
    flat = positional(docs)
    joined = flat.join(per, flat[f"_{i}"].cast("string").eqNullSafe(F.col("_s")), "left")
    extra = (uniform(F.col(f"_{j}"), seed) < F.col("_r") - F.floor("_r")).cast("bigint")
    copies = F.floor("_r") + extra
    return joined.withColumn("_k", copies).filter("_k > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def copies_sql(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``mix_sources`` over ``table``, with ``copy_no``."""
    cases = " ".join(f"WHEN source = '{k}' THEN {v!r}::DOUBLE" for k, v in WEIGHTS.items())
    return f"""
WITH per AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')))::BIGINT AS tokens,
         CASE {cases} ELSE {OTHER!r}::DOUBLE END AS weight
  FROM {table} GROUP BY source),
rate AS (
  SELECT source, CASE WHEN tokens > 0
    THEN (SELECT sum(tokens) FROM per)::DOUBLE * weight / (SELECT sum(weight) FROM per) / tokens ELSE 1 END AS rate
  FROM per),
n AS (
  SELECT d.*, (floor(rate) + CASE WHEN
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
      < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS k
  FROM {table} d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source)
SELECT * EXCLUDE (k, c), c::INT AS copy_no FROM (SELECT *, unnest(range(1, k + 1)) AS c FROM n)"""


SQL = copies_sql()
