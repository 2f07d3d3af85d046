"""The assembly tree against elimination on explicit graphs, and the solver over it against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import elimination, ordering, solvers, sparsity
from tessera.plans import mesh_queries
from tessera.session import cut


def matrix(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, val double")


def vector(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "dof long, val double")


def grid(n: int) -> np.ndarray:
    line = np.eye(n, k=1) + np.eye(n, k=-1)
    return np.kron(line, np.eye(n)) + np.kron(np.eye(n), line) + 5 * np.eye(n * n)


def random_graph(n: int, share: float, seed: int) -> np.ndarray:
    a = np.random.default_rng(seed).random((n, n)) < share
    return (a | a.T | np.eye(n, dtype=bool)).astype(float)


def check_tree(spark, a: np.ndarray, tree: elimination.Tree) -> None:
    """Eliminating node by node in the tree's order leaves, at each front, exactly its border; parents hold what children leave."""
    n = len(a)
    near = {v: {int(w) for w in np.flatnonzero(a[v]) if w != v} for v in range(n)}
    place = {r.old: r.new for r in elimination.ordered(tree).collect()}
    assert sorted(place) == sorted(place.values()) == list(range(n))
    pivots, border = {}, {}
    for r in sorted(tree.pivots.collect(), key=lambda r: place[r.node]):
        pivots.setdefault(r.front, []).append(r.node)
    for r in tree.border.collect():
        border.setdefault(r.front, set()).add(r.node)
    level = {r.front: r.level for r in tree.levels.collect()}
    parent = {r.front: r.parent for r in tree.parents.collect()}
    rounds = {r.node: (r.round, r.head) for r in tree.pivots.collect()}
    assert set(level) == set(pivots) and max(level.values(), default=0) == tree.height
    for front in sorted(pivots, key=lambda f: place[f]):
        assert pivots[front][0] == front
        for v in pivots[front]:
            members = near.pop(v)
            for u in members:
                near[u] = (near[u] | members) - {u, v}
            left = members - set(pivots[front])
            assert left == border.get(front, set())
        assert (front in parent) == bool(border.get(front))
        if front in parent:
            assert border[front] <= set(pivots[parent[front]]) | border.get(parent[front], set()) and level[parent[front]] > level[front]
    # heads of a round do not touch: none is in another's border
    heads = {}
    for v, (k, head) in rounds.items():
        if head:
            heads.setdefault(k, set()).add(v)
    assert all(not border.get(f, set()) & heads[rounds[f][0]] for f in pivots)


@pytest.mark.parametrize("a", [random_graph(18, 0.1, 1), np.kron(np.eye(2), np.ones((6, 6))), np.eye(24) + np.eye(24, k=1) + np.eye(24, k=-1)], ids=["sparse", "cliques", "path"])
def test_tree_is_an_elimination(spark, a):
    check_tree(spark, a, elimination.fronts(matrix(spark, a).select("row", "col")))


def test_first_round_takes_least_degrees(spark):
    """Degrees of the first round are exact; a node goes if none of its candidate neighbours comes before it."""
    a = random_graph(30, 0.1, 5)
    near = {v: [int(w) for w in np.flatnonzero(a[v]) if w != v] for v in range(30)}
    keys = {r.v: (len(near[r.v]), r.p, r.v) for r in spark.range(30).select(F.col("id").alias("v"), F.xxhash64("id").alias("p")).collect()}
    most = int(elimination.SLACK[0] * min(k[0] for k in keys.values())) + elimination.SLACK[1]
    able = {v for v, k in keys.items() if k[0] <= most}
    want = {v for v in able if all(keys[v] < keys[w] for w in near[v] if w in able)}
    tree = elimination.fronts(matrix(spark, a).select("row", "col"))
    assert {r.node for r in tree.pivots.filter("round = 0 and head").collect()} == want


def fill(a: np.ndarray, place: dict) -> int:
    order = sorted(place, key=place.get)
    near = {v: {int(w) for w in np.flatnonzero(a[v]) if w != v} for v in order}
    total = len(order)
    for v in order:
        members = near.pop(v)
        total += 2 * len(members)
        for u in members:
            near[u] = (near[u] | members) - {u, v}
    return total


def test_less_fill_than_cuthill_mckee_on_a_grid(spark):
    a = grid(6)
    pat = cut(matrix(spark, a).select("row", "col"))
    of = lambda perm: fill(a, {r.old: r.new for r in perm.collect()})
    assert of(elimination.minimum_degree(pat)) < of(ordering.rcm(pat))


def test_solver_against_numpy(spark):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((24, 24)) < 0.09, rng.normal(size=(24, 24)), 0) + 6 * np.eye(24)  # not symmetric, in several parts
    a[12, :12] = a[12, 13:] = a[:12, 12] = a[13:, 12] = 0
    b = rng.normal(size=24)
    got = {r.dof: r.val for r in elimination.multifrontal(matrix(spark, a), vector(spark, b)).collect()}
    assert np.allclose([got[i] for i in range(24)], np.linalg.solve(a, b))


def test_solver_takes_repeats_missing_loads_and_nothing(spark):
    twice = matrix(spark, np.array([[2.0, 1], [1, 3]]))
    x = elimination.multifrontal(twice.unionByName(twice), vector(spark, [1.0])).orderBy("dof").collect()
    assert np.allclose([r.val for r in x], np.linalg.solve([[4, 2], [2, 6]], [1, 0]))
    none = elimination.multifrontal(twice.limit(0), vector(spark, []))
    assert none.columns == ["dof", "val"] and none.count() == 0
    with pytest.raises(Exception, match="Singular"):
        elimination.multifrontal(matrix(spark, np.ones((2, 2))), vector(spark, [1.0, 2.0])).collect()


def test_beyond_the_limit_of_the_dense_solver(spark):
    """A chain of 200 unknowns where direct() is held to 100."""
    n = 200
    ids = spark.range(n).select(F.col("id").alias("row"))
    mat = ids.select("row", F.inline(F.array(*[F.struct((F.col("row") + k).alias("col"), F.lit(v).alias("val")) for k, v in ((-1, -1.0), (0, 2.5), (1, -1.0))]))).filter(F.col("col").between(0, n - 1))
    x = spark.range(n).select(F.col("id").alias("dof"), (F.col("id") % 7).cast("double").alias("val"))
    rhs = cut(sparsity.spmv(mat, x))
    with pytest.raises(ValueError):
        solvers.direct(mat, rhs, limit=100)
    got = elimination.multifrontal(mat, rhs)
    off = got.join(x.withColumnRenamed("val", "want"), "dof").agg(F.count("*").alias("n"), F.max(F.abs(F.col("val") - F.col("want"))).alias("e")).first()
    assert off.n == n and off.e < 1e-9


def graph_of(spark, a, groups):
    """The pattern with the groups as members, and the matrix with all their pairs."""
    whole = a.copy()
    for _, nodes in groups:
        whole[np.ix_(nodes, nodes)] = 1
    return matrix(spark, a).select("row", "col"), spark.createDataFrame([(e, int(v)) for e, nodes in groups for v in nodes], "elem long, node long"), whole


@pytest.mark.parametrize("in_task", [True, False])
def test_groups_are_elements_and_lose_many_nodes_a_round(spark, monkeypatch, in_task):
    n = 60
    groups = [(e, np.flatnonzero(np.arange(n) ** 2 % 7 % 4 == e)) for e in range(3)]
    line = np.eye(n) + np.eye(n, k=7) + np.eye(n, k=-7)
    pat, members, whole = graph_of(spark, line, groups)
    if not in_task:
        monkeypatch.setattr(elimination, "TASK_ROWS", -1)
    tree = elimination.fronts(pat, groups=members)
    place = {r.old: r.new for r in elimination.ordered(tree).collect()}
    assert sorted(place) == sorted(place.values()) == list(range(n))
    near = {v: {int(w) for w in np.flatnonzero(whole[v]) if w != v} for v in range(n)}
    fronts, border = {}, {}
    for r in tree.pivots.collect():
        fronts.setdefault(r.front, set()).add(r.node)
    for r in tree.border.collect():
        border.setdefault(r.front, set()).add(r.node)
    for front in sorted(fronts, key=lambda f: place[f]):
        left = set()
        for v in sorted(fronts[front], key=lambda v: place[v]):
            members = near.pop(v)
            left |= members
            for u in members:
                near[u] = (near[u] | members) - {u, v}
        assert left - fronts[front] == border.get(front, set())
    parent = {r.front: r.parent for r in tree.parents.collect()}
    assert set(parent) == set(border) and all(border[f] <= fronts[p] | border.get(p, set()) for f, p in parent.items())
    assert tree.pivots.select("round").distinct().count() < 12 < max(len(nodes) for _, nodes in groups)


def test_one_task_goes_on_as_the_rounds_do(spark, monkeypatch):
    a = random_graph(40, 0.06, 3)
    pat, members, _ = graph_of(spark, a, [(0, np.arange(0, 12)), (1, np.arange(10, 20)), (9, np.arange(30, 31))])
    told = lambda t: [sorted(map(tuple, df.collect())) for df in (t.pivots, t.border, t.levels, t.parents)]
    for groups in (None, members):
        rows = []
        for most in (-1, 90, 10**6):
            monkeypatch.setattr(elimination, "TASK_ROWS", most)
            rows.append(told(elimination.fronts(pat, groups=groups)))
        assert rows[0] == rows[1] == rows[2]


def test_order_of_nations_makes_no_pairs(spark, tmp_path, monkeypatch):
    n = 2000  # two nations: two million pairs
    s = spark.range(n).select(F.col("id").alias("s_suppkey"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("s_nationkey"))
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(sparsity, "pattern", lambda *_: pytest.fail("pairs"))
    got = mesh_queries.minimum_degree_fill(spark, str(tmp_path)).first()
    assert (got.n, got.lowest, got.highest) == (n, 0, n - 1)
