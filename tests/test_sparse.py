"""Sparsity, orderings and solvers against small exact cases and brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import dense
from tessera.functions.prefix import dense_index, prefix_sum
from tessera.operators import ordering, solvers, sparsity, vectors
from tessera.session import cut
from pyspark.sql import functions as F

A = np.array([[3.0, 2, 0, 4], [2, 6, 6, 0], [0, 6, 11, 0], [4, 0, 0, 18]])
B = np.array([-1.0, -2, 3, 4])
X = [1.20689655, -2.2183908, 1.48275862, -0.04597701]


def matrix(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, val double")


def vector(spark, v):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "dof long, val double")


def values(df):
    return [r.val for r in df.orderBy("dof").collect()]


@pytest.mark.parametrize("how", ["direct", "cg", "gmres", "gmres_ilu"])
def test_solvers_give_the_golden_vector(spark, how):
    a, b = matrix(spark, A), vector(spark, B)
    if how == "gmres_ilu":
        x = solvers.gmres(a, b, solvers.ilu_preconditioner(a, sparsity.iluk(a, None)))
    else:
        x = getattr(solvers, how)(a, b)
    assert np.allclose(values(x), X, atol=1e-7)
    assert abs(solvers.largest_residual(a, x, b).first().val) < 1e-6


def test_direct_refuses_large_systems(spark):
    with pytest.raises(ValueError):
        solvers.direct(matrix(spark, A), vector(spark, B), limit=3)


def two_quads(spark):
    conn = [[0, 1, 2, 3], [1, 3, 4, 5]]
    return spark.createDataFrame([(e, i, n) for e, ns in enumerate(conn) for i, n in enumerate(ns)], "elem long, lnode int, node long")


def test_two_element_fill(spark):
    pat = sparsity.pattern(two_quads(spark))
    assert pat.count() == 28
    assert sparsity.iluk(pat, None).count() == 32


def brute_levels(a: np.ndarray, k: int) -> dict:
    n = len(a)
    lev = {(i, j): 0 for i in range(n) for j in range(n) if a[i, j] or i == j}
    for i in range(n):
        for j in range(i):
            if lev.get((i, j), k + 1) > k:
                continue
            for m in range(j + 1, n):
                if (j, m) in lev and lev[j, m] <= k:
                    new = lev[i, j] + lev[j, m] + 1
                    if new <= k:
                        lev[i, m] = min(lev.get((i, m), new), new)
    return lev


@pytest.mark.parametrize("seed,k", [(0, 1), (1, 2), (2, 2)])
def test_iluk_matches_row_elimination(spark, seed, k):
    rng = np.random.default_rng(seed)
    a = rng.random((12, 12)) < 0.2
    a = a | a.T | np.eye(12, dtype=bool)
    got = {(r.row, r.col): r.lev for r in sparsity.iluk(matrix(spark, a.astype(float)), k).collect()}
    assert got == brute_levels(a, k)


def brute_rcm(a: np.ndarray, root: int) -> dict:
    n, order, seen = len(a), [root], {root}
    front = [root]
    while len(order) < n:
        new = []
        for i in front:
            for j in np.flatnonzero(a[i]):
                if j not in seen:
                    seen.add(int(j))
                    new.append(int(j))
        if not new:
            new = [min(set(range(n)) - seen)]
            seen.add(new[0])
        order += new
        front = new
    return {node: n - 1 - i for i, node in enumerate(order)}


@pytest.mark.parametrize("seed", [3, 4])
def test_rcm_matches_sequential_order(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.random((15, 15)) < 0.12
    a = a | a.T | np.eye(15, dtype=bool)
    got = {r.old: r.new for r in ordering.rcm(matrix(spark, a.astype(float)).select("row", "col"), 2).collect()}
    assert got == brute_rcm(a, 2)


def test_q_order_is_a_permutation_inside_chunks(spark):
    pat = matrix(spark, np.eye(20) + np.eye(20, k=6) + np.eye(20, k=-6)).select("row", "col")
    perm = ordering.identity(spark.range(20).withColumnRenamed("id", "node"))
    got = ordering.q_order(pat, perm, 2.0, seed=1).collect()
    assert sorted(r.new for r in got) == list(range(20))
    assert all(r.old // 3 == r.new // 3 for r in got)


def test_constraints_and_products(spark):
    a = matrix(spark, A)
    held = spark.createDataFrame([(1,)], "dof long")
    got = {(r.row, r.col): r.val for r in sparsity.constrain(a, held).collect()}
    assert got[1, 1] == 1 and got[0, 1] == got[1, 0] == 0 and got[0, 0] == 3
    assert np.allclose(values(sparsity.spmv(a, vector(spark, B))), A @ B)
    assert values(vectors.constrain(vector(spark, B), held)) == [-1, 0, 3, 4]
    blocks = sparsity.coo_to_block(a, 2)
    back = {(r.row, r.col): r.val for r in sparsity.block_to_coo(blocks, 2).filter("val <> 0").collect()}
    assert back == {(int(i), int(j)): A[i, j] for i, j in zip(*np.nonzero(A), strict=True)}


def test_permutation_round_trip(spark):
    perm = spark.createDataFrame([(0, 2), (1, 0), (2, 3), (3, 1)], "old long, new long")
    v = vector(spark, range(8))
    there = vectors.permute(v, perm, 2)
    assert values(vectors.permute(there, ordering.inverse(perm), 2)) == list(map(float, range(8)))


def test_prefix_sums_with_many_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 7 + 3).alias("k"), (F.col("id") % 5).alias("v"))
    got = prefix_sum(df, "k", F.col("v"), "p", bucket_rows=64).orderBy("k").collect()
    total = 0
    for r in got:
        assert r.p == total
        total += r.v
    ranks = dense_index(spark.createDataFrame([(5,), (5,), (9,), (-2,)], "k long"), "k", "i").collect()
    assert sorted((r.k, r.i) for r in ranks) == [(-2, 0), (5, 1), (5, 1), (9, 2)]


def test_dense_inverse_and_singular():
    inv, code = dense.inverse(A)
    assert code == 0 and np.allclose(inv @ A, np.eye(4))
    assert dense.inverse(np.zeros((2, 2)))[1] == 1


def test_argmax_and_relative_error(spark):
    v = spark.createDataFrame([(0, 3.0), (1, -4.0), (2, 4.0)], "dof long, val double")
    assert tuple(vectors.argmax_abs(v).first()) == (1, -4.0)
    assert vectors.rel_error(v, v).first().rel_error == 0


def test_factors_applied_in_one_task():
    rng = np.random.default_rng(4)
    full = np.where(rng.random((30, 30)) < 0.3, rng.normal(size=(30, 30)), 0) + 5 * np.eye(30)
    i, j = np.nonzero(full)
    mixed = rng.permutation(len(i))
    b = rng.normal(size=30)
    want = np.linalg.solve((np.tril(full, -1) + np.eye(30)) @ np.triu(full), b)
    assert np.allclose(dense.substituted(i[mixed], j[mixed], full[i, j][mixed], b), want)
    off = i != j
    with pytest.raises(ZeroDivisionError):
        dense.substituted(i[off], j[off], full[i, j][off], b)


def test_cut_has_the_size_of_its_rows(spark):
    """After 30 rounds of joins the optimiser still knows the size of the written rows."""
    x = cut(spark.range(50).select(F.col("id").alias("k"), F.lit(1.0).alias("v")))
    for _ in range(30):
        x = cut(x.join(x.select("k", F.col("v").alias("w")), "k").select("k", (F.col("v") + 0 * F.col("w")).alias("v")))
    assert x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
    assert x.agg(F.sum("v")).first()[0] == 50


@pytest.mark.parametrize("n", [3_000, 100_000])
def test_components_of_long_paths_settle(spark, n):
    ids = spark.range(n - 1)
    got = ordering.components(ids.select(F.col("id").alias("row"), (F.col("id") + 1).alias("col")))
    assert got.filter("comp = 0").count() == got.count() == n


def test_krylov_loops_on_larger_systems(spark):
    """A random positive matrix, and one without symmetry, against numpy; the residuals fall below the bound."""
    rng = np.random.default_rng(5)
    a = np.where(rng.random((60, 60)) < 0.1, rng.normal(size=(60, 60)), 0)
    spd, b = a @ a.T + 5 * np.eye(60), rng.normal(size=60)
    seen = []
    assert np.allclose(values(solvers.cg(matrix(spark, spd), vector(spark, b), history=seen)), np.linalg.solve(spd, b), atol=1e-7)
    assert seen[-1][1] < 1e-9 * np.linalg.norm(b) * 10
    odd = a + 6 * np.eye(60)
    got = solvers.gmres(matrix(spark, odd), vector(spark, b), restart=12)
    assert np.allclose(values(got), np.linalg.solve(odd, b), atol=1e-7)
