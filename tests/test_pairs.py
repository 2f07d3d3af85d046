"""What patterns and their numbers move between tasks."""

from __future__ import annotations

from tessera.operators import sparsity, topology
from tessera.plans import queries


def test_a_pattern_makes_each_pair_once(spark):
    mesh = spark.createDataFrame([(e, v) for e in range(3) for v in (e, 10 + e, 20 + e, 30)], "elem long, node long")
    pat = sparsity.pattern(mesh)
    want = {(a, b) for e in range(3) for a in (e, 10 + e, 20 + e, 30) for b in (e, 10 + e, 20 + e, 30)}
    got = [(r.row, r.col) for r in pat.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "slice(" in pat._jdf.queryExecution().optimizedPlan().toString()


def test_transposed_places_join_no_entries(spark):
    pat = spark.createDataFrame([(0, 2), (2, 1), (0, 1), (5, 2)], "row long, col long")
    found = sparsity.transpose_map(pat)
    assert {tuple(r) for r in found.collect()} == {(0, 1, 0, 0), (0, 2, 1, 2), (2, 1, 2, 1), (5, 2, 3, 3)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # one for each table of offsets


def test_pairs_are_made_in_tasks_of_bounded_rows(spark, monkeypatch):
    """Tasks go by the rows of elements, not by the bytes that they have before pairs are made."""
    monkeypatch.setattr(sparsity.tasks, "__defaults__", (5,))
    mesh = spark.createDataFrame([(e, v) for e in range(10) for v in (e, 10 + e, 20 + e, 30, None)], "elem long, node long")
    pat = sparsity.pattern(mesh)
    assert {r.row for r in pat.collect()} == {*range(31)} and pat.count() == pat.distinct().count() == 31 + 2 * 10 * 6
    assert "RepartitionByExpression [elem" in pat._jdf.queryExecution().logical().toString() and sparsity.pairs(mesh).rdd.getNumPartitions() == 11


def test_places_in_a_wider_pattern_and_none_outside_it(spark):
    """Repeated nodes, entries of no element, and pairs that the pattern lacks; no pair is joined with the entries."""
    mesh = spark.createDataFrame([(1, 0, 7), (1, 1, 5), (1, 2, 7), (2, 0, 5), (2, 1, 9), (2, 2, None)], "elem long, lnode int, node long")
    pat = spark.createDataFrame([(5, 4), (5, 5), (5, 7), (6, 9), (7, 7), (7, 5), (7, 8)], "row long, col long")
    idx = {(r, c): k for k, (r, c) in enumerate(sorted({(5, 4), (5, 5), (5, 7), (6, 9), (7, 7), (7, 5), (7, 8)}))}
    rows = [(1, 0, 7), (1, 1, 5), (1, 2, 7), (2, 0, 5), (2, 1, 9)]
    want = sorted((e, n, m, idx[a, b]) for e, n, a in rows for f, m, b in rows if e == f and (a, b) in idx)
    found = sparsity.elem_index_map(mesh, pat)
    assert sorted(map(tuple, found.collect())) == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the rows' starts
    turned = spark.createDataFrame([(7, 5), (5, 7), (9, 9)], "old long, new long")
    other = sparsity.elem_index_map(mesh, sparsity.apply_perm(pat, turned), turned)
    assert sorted(map(tuple, other.collect())) == [(1, 0, 0, 0), (1, 0, 1, 1), (1, 0, 2, 0), (1, 1, 0, 2), (1, 1, 1, 3), (1, 1, 2, 2), (1, 2, 0, 0), (1, 2, 1, 1), (1, 2, 2, 0), (2, 0, 0, 3)]


def test_a_mirrored_union_shuffles_no_mirror_image(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 4), (None, 5), (None, None), (5, None)], "row long, col long")
    b = spark.createDataFrame([(2, 2), (1, 3), (6, 1)], "row long, col long")
    found = sparsity.union_pattern(a, b, mirrored=True)
    rows = {tuple(r) for r in a.union(b).collect()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == rows | {(c, r) for r, c in rows}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2


def test_shared_orders_are_counted_one_way(spark, tmp_path):
    """The matrix that apply_perm renumbers: repeated and null suppliers, and pairs in tasks of their own."""
    lines = [(1, 1, 10), (1, 2, 20), (1, 3, 10), (2, 1, 20), (2, 2, 10), (2, 3, None), (3, 1, 20), (4, 1, 30)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, 2), (20, 1)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries.QUERIES["apply_perm"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(0, 0, 320), (0, 1, 220), (1, 0, 210), (1, 1, 210)]
    assert "slice(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_halo_is_dealt_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(sparsity.tasks, "__defaults__", (5,))
    mesh = spark.createDataFrame([(e, v) for e in range(20) for v in (e, e + 1)] + [(50, None), (51, 99)], "elem long, node long")
    owned = spark.createDataFrame([(3,), (3,), (50,), (77,)], "elem long")
    for layers, want in ((1, {2, 3, 4}), (2, {1, 2, 3, 4, 5})):
        found = topology.halo(mesh, owned, layers)
        got = [r.elem for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
    assert "RepartitionByExpression [node" in found._jdf.queryExecution().logical().toString()


def test_values_are_copied_in_as_many_tasks_as_given(spark):
    pat = spark.createDataFrame([(r, c) for r in range(6) for c in range(3)], "row long, col long")
    mat = spark.createDataFrame([(1, 1, 2.0), (5, 0, 3.0), (9, 9, 4.0)], "row long, col long, val double")
    found = sparsity.merge_copy(pat, mat, 7)
    want = {(r, c, {(1, 1): 2.0, (5, 0): 3.0}.get((r, c), 0.0)) for r in range(6) for c in range(3)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == 18
    assert found._jdf.queryExecution().logical().toString().count("RepartitionByExpression [row") == 2
