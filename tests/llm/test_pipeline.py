"""The pipeline: each stage on its own input, and its decisions checked by other means."""

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F

from orbitlake.llm import common, packing, simhash, source_mix


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, small).cache()
        seen[name] = (docs, out)
        if name != cp.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert out.filter(F.length("text") != F.col("n_chars")).count() == 0
        docs = out
    before, after = (x.count() for x in seen["language ID"])
    assert after >= 0.98 * before
    lines = seen["line dedup"][1].select(F.explode(F.split("text", "\n")).alias("x")).filter("trim(x) <> ''")
    assert lines.count() == lines.distinct().count()
    one = simhash.fingerprint_table(seen["near-duplicate documents"][1]).filter("pop is not null").toPandas()
    h = [one[c].to_numpy().astype("i8").view("u8") for c in ("h0", "h1")]
    d = sum(np.bitwise_count(x[:, None] ^ x[None, :]).astype(int) for x in h)
    m = one["m"].to_numpy().astype("i8").view("u8")
    assert ((d <= simhash.RADIUS) & (np.bitwise_count(m[:, None] ^ m[None, :]) <= simhash.SKETCH)).sum() == len(one)
    mixed = seen["mixing sources"]
    want = source_mix.mix_sources(mixed[0]).count()
    assert mixed[1].count() == want
    packed = seen["packing"][1].agg(F.sum("n_tokens")).first()[0]
    tokens = mixed[1].agg(F.sum(source_mix.n_tokens(F.col("text")) + F.when(source_mix.n_tokens(F.col("text")) > 0, 1).otherwise(0))).first()[0]
    assert packed == tokens and seen["packing"][1].groupBy("pack_id").agg(F.sum("n_tokens").alias("n")).filter(f"n > {packing.LENGTH}").count() == 0


def test_run_is_repeatable(spark, small):
    a, b = (sorted(tuple(r) for r in cp.run(spark, small).collect()) for _ in range(2))
    assert a == b and a


def test_run_on_awkward_tables(spark, tmp_path):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [(1, text * 3, "en", "s1", 1), (1, text * 3, "en", "s1", 1), (2, None, "en", "s1", 0), (3, "", None, None, 0), (None, text + "lambda mu nu xi", "en", None, 5), (4, text * 9_000, "en", "s1", 1), (5, " \n\t", "en", "s2", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(7) for c in ("copy_no", "k1", "kept", "_0", "row")})
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        stages = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in cp.STAGES[:-1]:
            stages = stage(spark, stages, "")
            assert stages.columns == docs.columns
        got = cp.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in got} <= {1, None, 4} and (name == "some") == bool(got)
        assert all(len(r.text.split()) <= packing.LENGTH for r in got)


def test_line_stage_leaves_no_table_of_lines(spark):
    """Later stages don't carry the second stage's scratch tables along."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    start = common.mark(spark)
    dict(cp.STAGES)["line dedup"](spark, docs, "/root/testdata/sf0.001")
    left = common._made[spark.sparkContext.applicationId][start:]
    assert left and all("line" not in spark.read.parquet(path).columns for path in left)
