"""Corpus preparation: STAGES over ``documents``, each written as Parquet and reread by the next.

1. language ID: documents that the classifier rejects go.
2. line dedup: of similar lines one stays; documents whose lines are all duplicates go.
3. near-duplicate documents: one document of each group stays.
4. mixing sources: documents are repeated or left out to reach the target weights.
5. packing: the pieces of the packs with their texts, in the order of the space-filling curve.

Cases: documents with a null or empty text are rejected by stage 1, so the others never see one; a null ``doc_id`` is a
document like any other, the last at ties; a null source is a source of its own; of rows equal in ``doc_id`` and text stage 2
leaves one; texts of any length are used whole; stages 1 to 4 pass other columns through, whatever their names (``copy_no``
of an input stays as it is), stage 5 leaves them out; an empty table gives an empty table. Line dedup takes from a near copy
whatever it shares with the document kept, so what reaches stage 3 of it is mostly the changed lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orbitlake.llm import language_id, line_dedup, packing, simhash, source_mix
from orbitlake.llm.common import mark, release, scratch_path
from orbitlake.session import reach_workers


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near-duplicate documents", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("packing", pack),
]
#: Language ID, MinHash, SimHash and the Hilbert order can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder before the next begins, and deleted after it."""
    docs, start = reach_workers(spark).read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, start, keep=path)
        docs = spark.read.parquet(path)
    return docs
