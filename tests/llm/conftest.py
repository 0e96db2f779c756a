from __future__ import annotations

import pytest


@pytest.fixture(autouse=True, scope="session")
def few_partitions(spark):
    """The tables are tiny; every task of a worker costs more than its rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
