"""Texts of runs: one file each, or many of them in the files of a bundle.

A file of a bundle holds members, each its path, a line break and its text, ended by ``SEPARATOR``. So runs by the
hundred thousand need no file, folder, listing and commit of their own, and files are read in splits by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = "\x1e"


def write_bundle(texts: DataFrame, folder: str) -> None:
    """Members of ``texts(path, value)``: null texts are empty ones; a separator within a member, or a line break within a path, is an error."""
    bad = F.col("path").isNull() | F.contains("path", F.lit("\n")) | F.contains(F.concat("path", F.coalesce("value", F.lit(""))), F.lit(SEPARATOR))
    member = F.concat(F.col("path"), F.lit("\n"), F.coalesce("value", F.lit("")))
    texts.select(F.when(bad, F.raise_error(F.lit("a member without a path, or with a separator in it"))).otherwise(member).alias("value")).write.option("lineSep", SEPARATOR).text(folder)


def read_texts(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """``(path, value)``: whole files, or the members of bundles."""
    if not bundled:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    members = spark.read.text(path, lineSep=SEPARATOR)
    name = F.substring_index("value", "\n", 1)
    return members.select(name.alias("path"), F.substr("value", F.length(name) + 2).alias("value"))
