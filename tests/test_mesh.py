"""Elements, assembly, transfer, readers and topology."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, shell, triangle
from tessera.operators import topology, transfer
from tessera.plans import pipelines
from tessera.plans.assembler import Assembler, triangle_kernel, uniform_material
from tessera.sources import bdf, generators, sinks, su2


def test_shell_element_has_six_rigid_motions():
    x = np.array([[[0, 0, 0], [1, 0, 0.1], [0, 0.5, 0], [1, 0.5, 0.1]]])
    k = shell.stiffness(x, 70e9, 0.3, 0.005)[0]
    w = np.linalg.eigvalsh(k)
    assert np.abs(k - k.T).max() < 1e-12 * np.abs(k).max()
    assert (np.abs(w) < 1e-9 * w.max()).sum() == 6


def test_shell_regression_values():
    i = np.arange(12)
    x = (1.0345452 + 2.23123432 * i + 0.323 * i**2).reshape(1, 4, 3)
    j = np.arange(24)
    q, p, p2 = (1.4543 + 6.4323 * j) * 1e-6, -1.4543 + 2.312 * 6.4323 * j, -1.4543 * 1.024343 + 2.812 * -9.4323 * j
    k = shell.stiffness(x, 70e9, 0.3, 0.005)[0]
    assert 0.5 * q @ k @ q == pytest.approx(6.97367615e04, rel=1e-7)
    assert p @ k @ q == pytest.approx(3.22446807e11, rel=1e-7)
    assert p @ k @ p2 == pytest.approx(-1.32958165e18, rel=1e-7)


def test_triangle_has_three_rigid_motions():
    k = triangle.stiffness(np.array([[[0, 0], [2, 1], [1, 2]]], float), 70e9, 0.3, 0.005)[0]
    w = np.linalg.eigvalsh(k)
    assert (np.abs(w) < 1e-9 * w.max()).sum() == 3


@pytest.mark.parametrize("n,ratio", [(4, 1.0610), (8, 1.0156)])
def test_plate_converges_to_kirchhoff(spark, n, ratio):
    m = pipelines.plate(spark, n, n)
    u = m.solve(generators.plate_loads(m.nodes, 1.0, 2.0, 1.0, n, n))
    centre = n // 2 + (n + 1) * (n // 2)
    amplitude = 1 / (70e9 * 0.005**3 / (12 * 0.91) * math.pi**4 * (1 / 16 + 1 + 1 / 2))
    assert u.filter(F.col("dof") == 6 * centre + 2).first().val / amplitude == pytest.approx(ratio, abs=2e-4)


def test_energy_is_half_of_work(spark):
    m = pipelines.plate(spark, 3, 3)
    v = generators.random_vector(m.zero_vector().select("dof"), seed=3)
    r = m.residual(v)
    work = r.join(v.withColumnRenamed("val", "u"), "dof").agg(F.sum(F.col("val") * F.col("u"))).first()[0]
    assert m.energy(v) == pytest.approx(work / 2, rel=1e-10)
    perm, filled = m.symbolic_factorization()
    assert perm.count() == 16 and filled.count() >= m.node_pattern().count()


def test_triangles_plug_in(spark):
    """Two triangles of a square: a linear field needs no inner force, and stretching stores t E e^2 / 2 (nu = 0)."""
    xy = [(0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5), (0, 0.5), (0.5, 0), (0.5, 1), (1, 0.5)]
    nodes = spark.createDataFrame([(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(xy)], "node long, x double, y double, z double")
    conn = [[0, 1, 2, 4, 5, 6], [3, 2, 1, 4, 8, 7]]
    elems = spark.createDataFrame([(e, i, n) for e, ns in enumerate(conn) for i, n in enumerate(ns)], "elem long, lnode int, node long")
    m = Assembler(nodes, elems, uniform_material(elems.select("elem").distinct(), 2.0, 0.0, 0.5), spark.createDataFrame([], "dof long"), triangle_kernel(), 2)
    field = nodes.select((F.col("node") * 2).alias("dof"), (F.col("x") * 0.1).alias("val")).union(nodes.select(F.col("node") * 2 + 1, F.lit(0.0)))
    assert m.energy(field) == pytest.approx(0.5 * 0.5 * 2.0 * 0.1**2)
    inner = m.residual(field).filter("dof in (8, 9)").collect()  # the node in the middle of the square
    assert all(abs(r.val) < 1e-12 for r in inner)


def test_plate_by_gmres(spark):
    direct = pipelines.plate(spark, 2, 2)
    u = direct.solve(generators.plate_loads(direct.nodes, 1.0, 2.0, 1.0, 2, 2)).orderBy("dof").collect()
    x = pipelines.plate_gmres(spark, 2, 2).orderBy("dof").collect()
    assert np.allclose([r.val for r in x], [r.val for r in u], atol=1e-9, rtol=1e-4)


@pytest.mark.parametrize("linear", [True, False])
def test_transfer_keeps_load_and_work(spark, linear):
    xs, xa = generators.grid_points(spark, 5, 5, z0=-0.2).cache(), generators.grid_points(spark, 7, 7, z0=-0.1).cache()
    table = transfer.transfer_table(xs, xa, 8, 20.0).cache()
    assert all(abs(r.s - 1) < 1e-12 for r in table.groupBy("a").agg(F.sum("w").alias("s")).collect())
    us, fa = generators.wavy_field(xs, 1e-6), generators.shear_field(xa, 10.0)
    if linear:
        ua, fs = transfer.linear_displacements(table, xs, xa, us), transfer.linear_loads(table, xs, xa, fa)
    else:
        flat = us.select("id", *[F.lit(0.0).alias(c) for c in "xyz"])
        ua, fs = transfer.displacements(table, xs, xa, us), transfer.loads(table, xs, xa, flat, fa)
    total = lambda v: np.array(v.agg(*[F.sum(c) for c in "xyz"]).first())
    assert np.allclose(total(fs), total(fa), atol=1e-10)

    def work(u, f):
        f = f.select("id", *[F.col(c).alias("f" + c) for c in "xyz"])
        return u.join(f, "id").agg(F.sum(F.expr("x * fx + y * fy + z * fz"))).first()[0]

    assert work(ua, fa) == pytest.approx(work(us, fs), rel=1e-9 if linear else 1e-4)


def test_rigid_motion_is_reproduced(spark):
    xs, xa = generators.grid_points(spark, 5, 5, z0=-0.2).cache(), generators.grid_points(spark, 4, 4, z0=-0.1).cache()
    a = 0.7
    turn = lambda p: p.select("id", (F.col("x") * math.cos(a) - F.col("y") * math.sin(a) - F.col("x") + 1).alias("x"), (F.col("x") * math.sin(a) + F.col("y") * math.cos(a) - F.col("y")).alias("y"), F.lit(2.0).alias("z"))
    got = transfer.displacements(transfer.transfer_table(xs, xa, 8, 20.0), xs, xa, turn(xs)).orderBy("id").collect()
    want = turn(xa).orderBy("id").collect()
    assert np.allclose([r[1:] for r in got], [r[1:] for r in want], atol=1e-9)


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    s, a = rng.random((60, 3)) * [1, 1, 0.1], rng.random((20, 3)) * 3 - 1
    s[10] = s[11]
    frame = lambda p: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")
    got = {(r.a, r.k): r.s for r in transfer.knn(frame(a), frame(s), 5).collect()}
    for i, p in enumerate(a):
        d = ((s - p) ** 2)[:, [1, 2, 0]]
        order = np.lexsort((np.arange(60), (s[:, 0] - p[0]) ** 2 + d[:, 0] + d[:, 1]))
        assert [got[i, k] for k in range(5)] == order[:5].tolist()
    assert transfer.knn(frame(a), frame(s[:3]), 5).count() == 60
    assert transfer.knn(frame(a), frame(s[:0].reshape(0, 3)), 5).count() == 0


BULK = """SOL 103
BEGIN BULK
$       Shell element data                       SKIN
GRID*                 10                             0.0             1.0
*                    0.5
GRID    20              4.-4    5.34+2  1.0D+3
GRID,30,,1.0,2.0,3.0
GRID    40              0.0     0.0
CQUAD4  7       1       10      20      30      40
SPC     1       20      136     0.5
FOO     1
END BULK
"""


def test_bulk_data(spark, tmp_path):
    (tmp_path / "a.bdf").write_text(BULK.replace("GRID,30,,", "GRID    ,30,,"))
    d = bdf.read(spark, str(tmp_path / "a.bdf"))
    nodes = {r.node: (r.x, r.y, r.z) for r in d.nodes.collect()}
    assert nodes[0] == (0.0, 1.0, 0.5) and nodes[1] == (4e-4, 534.0, 1000.0) and nodes[3] == (0, 0, 0)
    assert [r.node for r in d.elem_nodes.orderBy("lnode").collect()] == [0, 1, 3, 2]
    assert sorted((r.node, r.dof, r.val) for r in d.spc.collect()) == [(1, 0, 0.5), (1, 2, 0.5), (1, 5, 0.5)]
    assert [r.keyword for r in d.warnings.collect()] == ["FOO"]
    assert d.components.first().name == "SKIN"


@pytest.mark.parametrize("change", [("FOO     1", ""), ("30      40", "30      99"), ("CQUAD4  7 ", "CQUAD4  0 "), ("      30      40", "")])
def test_bulk_data_errors(spark, tmp_path, change):
    (tmp_path / "b.bdf").write_text(BULK.replace("GRID,30,,", "GRID    ,30,,").replace(*change))
    with pytest.raises(bdf.BulkDataError):
        bdf.read(spark, str(tmp_path / "b.bdf"))


@pytest.mark.parametrize("order,nodes,per", [(2, 12, 4), (3, 35, 9)])
def test_annulus_file(spark, tmp_path, order, nodes, per):
    (tmp_path / "c.bdf").write_text(generators.annulus_bulk_data(2, order))
    d = bdf.read(spark, str(tmp_path / "c.bdf"))
    assert d.nodes.count() == nodes
    assert d.elem_nodes.count() == per * d.elems.count()
    if order == 2:
        u = pipelines.static_from_file(spark, str(tmp_path / "c.bdf"), vtk_path=str(tmp_path / "vtk"))
        assert u.agg(F.max("val")).first()[0] > 0
        text = [r.value for r in spark.read.text(str(tmp_path / "vtk")).collect()]
        assert text[0].startswith("# vtk") and "CELL_TYPES 6" in text


SU2 = """NDIME= 3
NELEM= 2
12 0 1 2 3 4 5 6 7 0
12 4 5 6 7 8 9 10 11 1
NPOIN= 12
""" + "\n".join(f"{i % 2} {i // 2 % 2} {i // 4} {i}" for i in range(12)) + """
NMARK= 1
MARKER_TAG= low
MARKER_ELEMS= 1
9 0 1 2 3
"""


def test_su2_and_topology(spark, tmp_path):
    (tmp_path / "a.su2").write_text(SU2)
    m = su2.read(spark, str(tmp_path / "a.su2"))
    assert m.nodes.count() == 12
    edges, faces, bound = m.connectivity()
    assert edges.select("edge").distinct().count() == 20
    assert faces.select("face").distinct().count() == 11
    assert topology.misoriented(faces).count() == 0
    row = bound.first()
    assert (row.elem, row.part, row.verts) == (0, 4, [0, 3, 2, 1])
    assert {(r.kind, r["name"], r.n) for r in m.summary().collect()} == {("element", "hex", 2), ("boundary", "low", 1)}
    assert topology.element_graph(m.elements, False).count() == topology.element_graph(m.elements).count() - 12


def test_array_functions(spark):
    m = [[2.0, 1, 0], [0, 3, 1], [1, 0, 4]]
    lit = F.array(*[F.array(*map(F.lit, r)) for r in m])
    r = spark.range(1).select(arrays.inv3(lit).alias("i"), arrays.mat_mat(lit, arrays.inv3(lit)).alias("e"), arrays.det3(lit).alias("d")).first()
    assert np.allclose(r.i, np.linalg.inv(m)) and np.allclose(r.e, np.eye(3)) and r.d == pytest.approx(np.linalg.det(m))
    texts = spark.createDataFrame([("4.-4",), ("5.34+2",), ("1.0D+3",), ("",), ("-2.5",)], "t string")
    assert [x.v for x in texts.select(arrays.nastran_real(F.col("t")).alias("v")).collect()] == [4e-4, 534.0, 1000.0, 0.0, -2.5]


def test_csv_vector_and_random_connectivity(spark, tmp_path):
    v = generators.random_vector(spark.range(9).withColumnRenamed("id", "dof"), 2.0)
    sinks.csv_vector(v).write.text(str(tmp_path / "v"))
    back = sinks.read_csv_vector(spark, str(tmp_path / "v")).orderBy("dof").collect()
    assert [r.val for r in back] == [r.val for r in v.orderBy("dof").collect()]
    conn = generators.random_connectivity(spark, 50, 9, 4)
    assert conn.groupBy("elem").agg(F.countDistinct("node").alias("n")).filter("n <> 4").count() == 0
