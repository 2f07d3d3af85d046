"""Incomplete factors by block rows against elimination of a whole array, and their application."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.functions import dense
from tessera.operators import incomplete, solvers, sparsity
from tessera.session import cut
from test_elimination import matrix, vector


def example(n: int, seed: int):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random((n, n)) < 0.12, rng.normal(size=(n, n)), 0) + 6 * np.eye(n)
    pat = (a != 0) | (rng.random((n, n)) < 0.05)  # some places to fill in
    return a, pat


@pytest.mark.parametrize("block", [4, 64])
def test_factors_equal_those_of_the_whole_array(spark, block):
    a, pat = example(22, 3)
    made = incomplete.factors(matrix(spark, a), matrix(spark, pat.astype(float)).select("row", "col"), block)
    assert made.count() == -(-22 // block)
    lo, up = (np.zeros((22, 22)) for _ in range(2))
    for out, rows in zip((lo, up), incomplete.split(made), strict=True):
        for r in rows.collect():
            out[r.row, r.col] = r.val
    i, j = np.nonzero(pat)
    want_lo, want_up = dense.ilu(i, j, a[i, j], 22)
    assert np.allclose(lo, want_lo * (pat | np.eye(22, dtype=bool))) and np.allclose(up, want_up * pat)
    b = np.random.default_rng(1).normal(size=22)
    got = {r.dof: r.val for r in incomplete.applied(made, block)(vector(spark, b)).collect()}
    assert np.allclose([got[k] for k in range(22)], np.linalg.solve(lo @ up, b))


def test_missing_rows_and_zero_pivots(spark):
    a = np.array([[2.0, 0, 0], [1, 4, 0], [0, 0, 5]])
    made = cut(incomplete.factors(matrix(spark, a), matrix(spark, a).select("row", "col"), 2))
    got = {r.dof: r.val for r in incomplete.applied(made, 2)(vector(spark, [2.0])).collect()}
    assert got == {0: 1.0, 1: -0.25, 2: 0.0}
    bad = np.array([[0.0, 1], [1, 1]])
    with pytest.raises(Exception, match="pivot 0 vanishes"):
        incomplete.factors(matrix(spark, bad), matrix(spark, np.ones((2, 2))).select("row", "col"), 2).collect()


def test_preconditioned_iteration(spark):
    a, _ = example(20, 5)
    mat, b = matrix(spark, a), np.arange(20.0)
    seen: list = []
    x = solvers.gmres(mat, vector(spark, b), solvers.ilu_preconditioner(mat, sparsity.iluk(mat.select("row", "col"), 1), block=8), history=seen)
    got = {r.dof: r.val for r in x.collect()}
    assert np.allclose([got[k] for k in range(20)], np.linalg.solve(a, b)) and len(seen) < 12
