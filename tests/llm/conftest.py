import pytest


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The tables here are tiny and the operators have many stages."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
