import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """These tests run many jobs over a few rows each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
