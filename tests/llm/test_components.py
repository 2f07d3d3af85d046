"""The component loop on long chains of links."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash


@pytest.mark.parametrize("n", [3_000, 100_000])
def test_paths_settle(spark, n):
    path = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = simhash.components(path).agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).first()
    assert got.low == got.high == 0 and got.n in (n - 1, n)
