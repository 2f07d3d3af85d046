"""Full fill by the elimination forest."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fill, sparsity
from tessera.plans import mesh_queries


def eliminated(pairs, n):
    a = np.eye(n, dtype=bool)
    for i, j in pairs:
        a[i, j] = a[j, i] = True
    for k in range(n):
        low = np.flatnonzero(a[k + 1 :, k]) + k + 1
        a[np.ix_(low, low)] = True
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)}


@pytest.mark.parametrize("block", [fill.BLOCK_EDGES, 15])
def test_fill_is_that_of_elimination(spark, monkeypatch, block):
    monkeypatch.setattr(fill, "BLOCK_EDGES", block)
    monkeypatch.setattr(fill, "BLOCK_NODES", 4)
    rng = np.random.default_rng(5)
    n = 40
    pairs = [(int(i), int(j)) for i, j in rng.integers(0, n - 1, (45, 2))]
    groups = [(int(g), int(v)) for g, v in zip(rng.integers(0, 8, 12), rng.integers(0, n, 12), strict=True)]
    whole = pairs + [(v, w) for g, v in groups for h, w in groups if g == h]
    own = [(v, v) for v in {x for p in whole for x in p}]
    pat = spark.createDataFrame(pairs, "row long, col long")
    elems = spark.createDataFrame(groups, "elem long, node long").distinct()
    got = [(r.row, r.col) for r in fill.entries(pat, elems).collect()]
    want = {(i, j) for i, j in eliminated(whole, n) if i != j} | set(own)
    assert len(got) == len(set(got))
    assert set(got) == want
    assert fill.count(pat, elems) == len(want)


def test_full_fill_makes_no_pairs(spark, tmp_path, monkeypatch):
    n = 300
    s = spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") * F.col("id") % 5).cast("int").alias("s_nationkey"))
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = {(r.row, r.col) for r in mesh_queries.small_graph(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(sparsity, "iluk", lambda *_: pytest.fail("paths, hop by hop"))
    monkeypatch.setattr(sparsity, "pattern", lambda *_: pytest.fail("pairs"))
    assert {(r.row, r.col) for r in mesh_queries.full_fill(spark, str(tmp_path)).collect()} == eliminated(pairs, n)


def test_fill_of_orders_is_counted_without_its_entries(spark, tmp_path, monkeypatch):
    n = 20
    s = spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).cast("int").alias("s_nationkey"))
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(sparsity, "iluk", lambda *_: pytest.fail("entries of the fill"))
    assert mesh_queries.minimum_degree_fill(spark, str(tmp_path)).first().asDict() == {"n": n, "lowest": 0, "highest": n - 1, "less_fill": True}


def test_chains_go_up_over_ranges(spark, monkeypatch):
    rng = np.random.default_rng(3)
    up = {v: None if v == 59 or v % 23 == 22 else int(rng.integers(v + 1, min(60, v + 4))) for v in range(60)}
    size = {v: 1 for v in up}
    for v, p in up.items():
        if p is not None:
            size[p] += size[v]
    tree = spark.createDataFrame([(v, p, size[v]) for v, p in up.items()], "node long, parent long, size long")
    want = sorted(map(tuple, fill.chains(tree).collect()))
    on = {max((v for v in up if up[v] == p), key=lambda v: (size[v], -v)): p for p in set(up.values()) - {None}}

    def top(v):
        return (*top(on[v])[:1], top(on[v])[1] + 1) if v in on else (v, 0)

    assert want == sorted((v, *top(v), up[top(v)[0]]) for v in up)
    monkeypatch.setattr(fill, "BLOCK_EDGES", 9)
    assert sorted(map(tuple, fill.chains(tree).collect())) == want


def test_pairs_of_the_fill_are_dealt_out(spark, monkeypatch):
    """Not all in one task, though all rows of a graph this small fit one task by their bytes."""
    monkeypatch.setattr(fill, "TASK_PAIRS", 500)
    monkeypatch.setattr(fill, "BLOCK_ROWS", 10)
    monkeypatch.setattr(fill, "BLOCK_NODES", 16)
    n = 80
    pat, groups = spark.createDataFrame([(0, 1)], "row long, col long"), spark.range(n).select(F.lit(1).cast("long").alias("elem"), F.col("id").alias("node"))
    got = fill.entries(pat, groups)
    made = got.filter("row <> col").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == n * (n - 1) and len(made) > 3 and max(r["count"] for r in made) < n * (n - 1) / 2
    assert got.distinct().count() == n * n
