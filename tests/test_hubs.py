"""Systems with an unknown for each group instead of the group's pairs, and what solves them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import incomplete, solvers, sparsity, ties
from tessera.plans import mesh_queries


def frame(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row long, col long, val double")


def dense(rows, n):
    a = np.zeros((n, n))
    for r in rows.collect():
        a[r.row, r.col] += r.val
    return a


def test_system_has_a_row_for_each_member_and_stands_for_all_pairs(spark, tmp_path, monkeypatch):
    n = 60
    s = spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") * F.col("id") % 5).cast("int").alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    s.write.parquet(str(tmp_path / "supplier.parquet"))
    pairs = {(r.row, r.col) for r in mesh_queries.small_graph(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(sparsity, "pattern", lambda *_: pytest.fail("pairs"))
    mat, rhs, _, hubs = mesh_queries._system(spark, str(tmp_path))
    assert mat.count() <= n * 5 + 5 < len(pairs)
    want = np.zeros((n, n))
    for r, c in pairs:
        want[r, c] = -1.0
    np.fill_diagonal(want, [sum(r == k for r, _ in pairs) for k in range(n)])
    assert np.array_equal(dense(ties.eliminated(mat, hubs), n), want)
    got = {r.dof: r.val for r in solvers.banded(mat, rhs, border=hubs).collect()}
    answer = np.linalg.solve(want, [r.val for r in rhs.orderBy("dof").collect()][:n])
    assert np.allclose([got[k] for k in range(n)], answer)


def test_a_long_chain_is_solved_in_the_rounds_of_its_blocks(spark, monkeypatch):
    n = 900
    rows = spark.range(n).select(F.col("id").alias("row"), F.explode(F.array(F.lit(0), F.lit(7))).alias("k")).filter("row >= k")
    mat = rows.select("row", (F.col("row") - F.col("k")).alias("col"), F.when(F.col("k") == 0, 2.0).otherwise(-1.0).alias("val"))
    written = []
    cut = solvers.cut
    for module in (solvers, incomplete):
        monkeypatch.setattr(module, "cut", lambda df: written.append(1) or cut(df))
    b = mat.groupBy(F.col("row").alias("dof")).agg(F.sum("val").alias("val"))
    got = solvers.triangular(mat, lower=True, unit=False)(b)
    assert got.filter("abs(val - 1) < 1e-9").count() == n
    assert len(written) < 20  # a chain of 129 rows
    small = solvers.triangular(mat, lower=True, unit=False, block=300)(b)
    assert small.filter("abs(val - 1) < 1e-9").count() == n


def test_factored_takes_systems_over_the_dense_limit(spark):
    a = np.array([[3.0, 2, 0, 4], [2, 6, 6, 0], [0, 6, 11, 0], [4, 0, 0, 18]])
    b = spark.createDataFrame([(k, v) for k, v in enumerate([-1.0, -2.0, 3.0, 4.0])], "dof long, val double")
    got = [r.val for r in solvers.factored(frame(spark, a), b, limit=3).orderBy("dof").collect()]
    assert np.allclose(got, np.linalg.solve(a, [-1, -2, 3, 4]))
