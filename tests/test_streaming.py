"""The stream form of scatter-add against the table form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming.scatter import scatter_add_stream


def test_stream_sums_equal_table_sums(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30)).alias("ts"), (F.col("id") % 3).alias("node"), F.col("id").alias("val"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = scatter_add_stream(stream, ["node"]).writeStream.format("memory").queryName("sums").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.window.start, r.node)
    got = {}
    for r in spark.table("sums").collect():  # updates: the last is the largest
        got[key(r)] = max(r.val, got.get(key(r), -1))
    assert got == {key(r): r.val for r in scatter_add_stream(rows, ["node"]).collect()}
