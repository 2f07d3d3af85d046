"""Prefix sums and dense numbering of a whole table, without a window over all of it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Rows in a range of keys on average, at most; a table of no more is one window.
BUCKET_ROWS = 50_000


def prefix_sum(df: DataFrame, key: str | list[str], value: Column, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sum of `value` over the rows with a smaller `key` (columns of any kind that sorts, without repeats), as `out`.

    Spark deals the rows into ranges of keys; each row is written with the number of
    its range, so that the ranges stay what they are whatever is run again. The sums of
    the ranges (a row each) are summed in order, and rows only inside their range.
    `df` is read several times: cut it first if it is dear.
    """
    keys = [key] if isinstance(key, str) else list(key)
    n = df.count()
    if n <= bucket_rows:
        w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("_v", value).withColumn(out, F.sum("_v").over(w) - F.col("_v")).drop("_v")
    ranged = cut(df.withColumn("_v", value).repartitionByRange(n // bucket_rows + 1, *keys).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(F.col("_range").alias("_r")).agg(F.sum("_v").alias("_t"))
    sums = sums.withColumn("_start", F.sum("_t").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).drop("_t")
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_in", F.sum("_v").over(inside) - F.col("_v")).join(F.broadcast(sums), F.col("_range") == F.col("_r"))  # a row for each range
    return placed.withColumn(out, F.col("_start") + F.col("_in")).drop("_v", "_range", "_r", "_start", "_in")


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows with `out`: the rank from 0 of their `key` (it may repeat) among its distinct values."""
    ranks = prefix_sum(df.select(F.col(key).alias("_key")).distinct(), "_key", F.lit(1).cast("long"), out)
    return df.join(ranks, F.col(key) == F.col("_key")).drop("_key")
