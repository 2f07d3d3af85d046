"""Parts by size and cut; ghosts against plain hops."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import partition
from test_dissection import KIND, grid


def test_grid(spark):
    edges = grid(16, 16)
    pat = spark.createDataFrame(edges, KIND)
    part = {r.node: r.part for r in partition.partition(pat, 4).collect()}
    sizes = Counter(part.values())
    assert len(part) == 256 and set(sizes) == {0, 1, 2, 3} and max(sizes.values()) <= 68 and min(sizes.values()) >= 60
    # equal shares of the nodes by distance from a corner; the best there is, quarters, cuts 32
    bands = {x: i // 64 for i, x in enumerate(sorted(part, key=lambda x: (x // 16 + x % 16, x)))}
    assert sum(part[a] != part[b] for a, b in edges) < 0.85 * sum(bands[a] != bands[b] for a, b in edges)


def test_odd_graphs(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 120)], KIND)
    sizes = Counter(r.part for r in partition.partition(star, 2).collect())
    assert sum(sizes.values()) == 120 and max(sizes.values()) <= 63
    alone = spark.createDataFrame([(i, i) for i in range(10)], KIND)
    assert sorted(Counter(r.part for r in partition.partition(alone, 2).collect()).values()) == [5, 5]
    assert partition.partition(spark.createDataFrame([], KIND), 3).count() == 0


def test_ghosts_and_exchange(spark):
    edges = grid(5, 4)
    part = {x: x % 5 // 2 for x in range(20)}
    parts = spark.createDataFrame(list(part.items()), "node long, part int")
    pat = spark.createDataFrame(edges, KIND)
    near = {x: {b for a, b in edges if a == x} | {a for a, b in edges if b == x} for x in range(20)}
    want = set()
    for p in set(part.values()):
        own = {x for x in part if part[x] == p}
        one = {y for x in own for y in near[x]} - own
        two = {y for x in one for y in near[x]} - own - one
        want |= {(p, x, part[x], 1) for x in one} | {(p, x, part[x], 2) for x in two}
    table = partition.ghosts(pat, parts, 2)
    assert {tuple(r) for r in table.collect()} == want
    values = parts.select("node", (F.col("node") * 3).alias("val"))
    got = partition.exchanged(values, parts, table).collect()
    assert len(got) == 20 + len(want) and all(r.val == 3 * r.node for r in got)
