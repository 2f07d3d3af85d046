"""Nested dissection: separation along every edge, and fill counted by plain elimination."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from tessera.operators import dissection

KIND = "row long, col long"


def grid(w: int, h: int) -> list[tuple[int, int]]:
    at = [(r, c) for r in range(h) for c in range(w)]
    return [(r * w + c, a * w + b) for r, c in at for a, b in ((r, c + 1), (r + 1, c)) if a < h and b < w]


def fill(edges, place) -> int:
    near = {}
    for a, b in edges:
        near.setdefault(place[a], set()).add(place[b])
        near.setdefault(place[b], set()).add(place[a])
    n = 0
    for i in sorted(near):
        later = {j for j in near[i] if j > i}
        n += len(later)
        for j in later:
            near[j] |= later - {j}
    return n


def order(frame) -> dict:
    got = {r.old: r.new for r in frame.collect()}
    assert sorted(got.values()) == list(range(len(got)))
    return got


def levels_reversed(edges) -> dict:
    """Nodes by their distance from node 0, reversed: what reverse Cuthill-McKee gives on a grid."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen = {0: None}
    for x in iter(queue := [0]):
        for y in sorted(near[x] - seen.keys()):
            seen[y] = None
            queue.append(y)
    return {x: len(seen) - 1 - i for i, x in enumerate(seen)}


def test_grid_fills_less_than_level_order(spark):
    edges = grid(14, 14)
    dissected = order(dissection.nested_dissection(spark.createDataFrame(edges, KIND), 32))
    assert fill(edges, dissected) < 0.8 * fill(edges, levels_reversed(edges))


def test_every_edge_stays_in_one_branch(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (55, 2)) if a != b})
    pat = spark.createDataFrame([*edges, (90, 90)], KIND)
    paths = {r.node: (r.path, r.separates) for r in dissection.tree(pat, 10).collect()}
    assert set(paths) == {x for e in edges for x in e} | {90} and paths[90] == ([90], False)
    for a, b in edges:
        p, q = sorted((paths[a][0], paths[b][0]), key=len)
        assert q[: len(p)] == p
    place = order(dissection.nested_dissection(pat, 10))
    for node, (path, separates) in paths.items():
        if separates:
            below = [x for x, (p, _) in paths.items() if len(p) > len(path) and p[: len(path)] == path]
            assert below and max(place[x] for x in below) < place[node]


def test_parts_that_cannot_be_cut(spark):
    clique = [(a, b) for a in range(6) for b in range(a)]
    star = [(10, 10 + i) for i in range(1, 8)]
    got = {r.node: (r.path, r.separates) for r in dissection.tree(spark.createDataFrame(clique + star, KIND), 3).collect()}
    assert all(got[i] == ([0], False) for i in range(6))
    assert got[10] == ([10], True) and all(got[10 + i] == ([10, 10 + i], False) for i in range(1, 8))
    assert dissection.tree(spark.createDataFrame([], KIND), 3).count() == 0


def test_a_sweep_takes_as_many_rounds_as_ranges(spark, monkeypatch):
    n = 400
    chain = spark.range(n - 1).select(F.col("id").alias("row"), (F.col("id") + 1).alias("col")).filter("row <> 299")
    edges = dissection.both_ways(chain)
    starts = spark.createDataFrame([(7, 120), (9, 399), (11, 1000)], "part long, node long")
    written = []
    whole = dissection.cut
    monkeypatch.setattr(dissection, "cut", lambda df: written.append(1) or whole(df))
    want = {(7, v, abs(v - 120)) for v in range(300)} | {(9, v, 399 - v) for v in range(300, n)} | {(11, 1000, 0)}
    for block in (dissection.BLOCK_EDGES, 150):
        monkeypatch.setattr(dissection, "BLOCK_EDGES", block)
        assert {tuple(r) for r in dissection.sweep(edges, starts).select("part", "node", "level").collect()} == want
    assert len(written) < 40  # levels are up to 179


def test_small_parts_are_cut_in_one_task_as_in_rounds(spark, monkeypatch):
    edges = [*grid(13, 11), *[(a + 500, b + 500) for a, b in grid(3, 30)], (900, 900)]
    pat = spark.createDataFrame(edges, KIND)
    written = []
    whole = dissection.cut
    monkeypatch.setattr(dissection, "cut", lambda df: written.append(1) or whole(df))
    own = lambda depths: sorted((r.node, r.path, r.separates) for r in dissection.tree(pat, 12, depths).collect())
    one = own(None)
    assert max(len(p) for _, p, _ in one) > 3 and len(written) < 12
    monkeypatch.setattr(dissection, "TASK_EDGES", 150)
    assert own(None) == one
    deep = own(2)
    monkeypatch.setattr(dissection, "TASK_EDGES", 10_000)
    assert own(2) == deep != one
