"""Graphs given with groups of nodes that are all joined: the same results as over all their pairs, and no table of pairs on the way."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import ordering, sparsity


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    groups = {(e, n) for e in range(7) for n in rng.sample(range(60), 5)} | {(7, 70), (7, 71)}
    edges = {(a, b) for _ in range(12) for a, b in [rng.sample(range(64), 2)]}
    far = spark.createDataFrame(sorted(edges | {(b, a) for a, b in edges}), "row long, col long")
    return far, spark.createDataFrame(sorted(groups), "elem long, node long")


def same(a, b):
    rows = lambda df: sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())
    assert rows(a) == rows(b)


def test_groups_stand_for_their_pairs(spark, graph):
    far, groups = graph
    pairs = ordering.with_pairs(far, groups)
    root = pairs.agg(F.min("row")).first()[0]
    same(ordering.levels(far, root, groups), ordering.levels(pairs, root))
    same(ordering.components(far, groups), ordering.components(pairs))
    same(ordering.rcm(far, root, groups), ordering.rcm(pairs, root))
    perm = ordering.identity(pairs.select(F.col("row").alias("node")).distinct())
    assert ordering.permuted_bandwidth(far, perm, groups) == sparsity.bandwidth(pairs).first()[0]
    got = ordering.q_order(far, perm, 2.0, 3, groups)
    same(got, ordering.q_order(pairs, perm, 2.0, 3))
    assert got.select("new").distinct().count() == perm.count()


def test_queries_of_orders_make_no_pairs_of_a_nation(spark, tmp_path, monkeypatch):
    n = 3000  # one nation: nine million pairs
    s = spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(1).alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(sparsity, "pattern", lambda *_: pytest.fail("pairs"))
    q = entry.queries()
    assert q["rcm_levels"](spark, str(tmp_path)).groupBy("level").count().orderBy("level").collect() == [(0, 1), (1, n - 1)]
    assert [tuple(r) for r in q["graph_components"](spark, str(tmp_path)).collect()] == [(0, n)]
