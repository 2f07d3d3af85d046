"""The three whole analyses: static solve of a file, preconditioned plate, transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ordering, solvers, sparsity, transfer, vectors
from tessera.plans.assembler import Assembler, uniform_material
from tessera.session import cut
from tessera.sources import bdf, generators, sinks


def static_from_file(spark: SparkSession, path: str, fz: float = 10.0, vtk_path: str | None = None, how: str = "direct", **material) -> DataFrame:
    """Bulk data -> stiffness -> constraints -> uniform load -> (dof, val), and a VTK file if a path is given."""
    data = bdf.read(spark, path)
    model = Assembler.from_bulk_data(data, **material)
    u = cut(model.solve(generators.uniform_load(data.nodes, fz), how))
    if vtk_path:
        sinks.write_lines(sinks.vtk_lines(data.nodes, data.elem_nodes, node_moves(u)), vtk_path)
    return u


def node_moves(u: DataFrame, dofs: int = 6) -> DataFrame:
    """(node, x, y, z): the first three dofs of each node."""
    at = [F.sum(F.when(F.col("dof") % dofs == i, F.col("val"))).alias(c) for i, c in enumerate("xyz")]
    return u.groupBy(F.floor(F.col("dof") / dofs).alias("node")).agg(*at)


def plate(spark: SparkSession, nxe: int, nye: int, lx: float = 2.0, ly: float = 1.0, e: float = 70e9, nu: float = 0.3, t: float = 0.005) -> Assembler:
    nodes = generators.plate_nodes(spark, nxe, nye, lx, ly)
    elems = generators.plate_elements(spark, nxe, nye)
    return Assembler(nodes, elems, uniform_material(elems.select("elem").distinct(), e, nu, t), generators.plate_bcs(nodes, nxe, nye))


def plate_gmres(spark: SparkSession, nxe: int, nye: int, p: float = 2.0, fill: int = 2, q: float = 1.0, tol: float = 1e-8, seed: int = 0) -> DataFrame:
    """Plate -> RCM -> chunk shuffle -> ILU(k) of the permuted matrix -> GMRES -> (dof, val) in the first order."""
    model, lx, ly, d = plate(spark, nxe, nye), 2.0, 1.0, 6
    pat = cut(model.node_pattern())
    perm = cut(ordering.q_order(pat, ordering.rcm(pat), p, seed))
    dof_perm = cut(perm.select(F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("d"), "*").select((F.col("old") * d + F.col("d")).alias("old"), (F.col("new") * d + F.col("d")).alias("new")))
    k = sparsity.constrain(model.matrix(), model.bcs)
    f = vectors.constrain(generators.plate_loads(model.nodes, q, lx, ly, nxe, nye), model.bcs)
    k, f = cut(sparsity.apply_perm(k, dof_perm)), cut(vectors.permute(f, dof_perm))
    levels = sparsity.iluk(sparsity.apply_perm(pat, perm), fill)
    cells = F.sequence(F.lit(0), F.lit(d - 1))
    wide = levels.withColumn("i", F.explode(cells)).withColumn("j", F.explode(cells)).select((F.col("row") * d + F.col("i")).alias("row"), (F.col("col") * d + F.col("j")).alias("col"))
    x = solvers.gmres(k, f, solvers.ilu_preconditioner(k, cut(wide)), tol=tol)
    return vectors.permute(x, ordering.inverse(dof_perm))


def load_transfer(spark: SparkSession, linear: bool = True, n_s: int = 17, n_a: int = 30, k: int = 32, beta: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(ua, fs): displacements of the a grid under 20 degrees of shear, and loads on the s grid from a 10-degree field."""
    xs = cut(generators.grid_points(spark, n_s, n_s, z0=-0.2))
    xa = cut(generators.grid_points(spark, n_a, n_a, z0=-0.1))
    us, fa = generators.shear_field(xs, 20.0), generators.shear_field(xa, 10.0)
    table = cut(transfer.transfer_table(xs, xa, k, beta))
    if linear:
        return transfer.linear_displacements(table, xs, xa, us), transfer.linear_loads(table, xs, xa, fa)
    return transfer.displacements(table, xs, xa, us), transfer.loads(table, xs, xa, us, fa)
