"""Tied dofs against T' K T of whole arrays; chains, repeats and cycles."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import ties
from test_elimination import matrix, vector

KIND = "dof long, master long, coef double"


def test_condensed_system(spark):
    rng = np.random.default_rng(3)
    k, f = rng.normal(size=(8, 8)), rng.normal(size=8)
    # 7 = 6, 6 = 2 * 5 - 1 * 0, 4 = 3 (told in two halves), the rest is free
    rows = [(7, 6, 1.0), (6, 5, 2.0), (6, 0, -1.0), (4, 3, 0.5), (4, 3, 0.5)]
    t = np.eye(8)
    t[4] = t[3]
    t[6] = 2 * t[5] - t[0]
    t[7] = t[6]
    free = [0, 1, 2, 3, 5]
    t = t[:, free]
    table = ties.resolved(spark.createDataFrame(rows, KIND))
    got = np.zeros((8, 8))
    for r in ties.condensed(matrix(spark, k), table).collect():
        got[r.row, r.col] += r.val
    assert np.allclose(got[np.ix_(free, free)], t.T @ k @ t) and not got[[4, 6, 7]].any() and not got[:, [4, 6, 7]].any()
    load = {r.dof: r.val for r in ties.condensed_load(vector(spark, f), table).collect()}
    assert np.allclose([load[i] for i in free], t.T @ f) and len(load) == 5
    x = rng.normal(size=5)
    every = {r.dof: r.val for r in ties.expanded(spark.createDataFrame(list(zip(free, x.tolist(), strict=True)), "dof long, val double"), table).collect()}
    assert np.allclose([every[i] for i in range(8)], t @ x)


def test_long_chain_and_none(spark):
    table = ties.resolved(spark.range(1, 200).selectExpr("id as dof", "id - 1 as master", "1.0D as coef")).collect()
    assert len(table) == 199 and all(r.col == 0 and r.val == 1 for r in table)
    assert ties.resolved(spark.createDataFrame([], KIND)).count() == 0


@pytest.mark.parametrize("rows", [[(1, 1, 1.0)], [(1, 2, 1.0), (2, 1, 1.0)], [(1, 2, 0.5), (2, 3, 1.0), (3, 1, 2.0), (3, 4, 1.0)]])
def test_cycles_are_told(spark, rows):
    with pytest.raises(ties.CycleError):
        ties.resolved(spark.createDataFrame(rows, KIND), max_rounds=8)
