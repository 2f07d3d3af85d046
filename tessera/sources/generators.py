"""Synthetic meshes and fields, from `spark.range`."""

from __future__ import annotations

from math import pi, radians, tan

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def plate_nodes(spark: SparkSession, nxe: int, nye: int, lx: float = 2.0, ly: float = 1.0) -> DataFrame:
    """(node, ix, iy, x, y, z): a grid of (nxe + 1) x (nye + 1) nodes, x fastest."""
    nnx = nxe + 1
    ix, iy = (F.col("id") % nnx).cast("int"), F.floor(F.col("id") / nnx).cast("int")
    return spark.range(nnx * (nye + 1)).select(F.col("id").alias("node"), ix.alias("ix"), iy.alias("iy"), (ix * (lx / nxe)).alias("x"), (iy * (ly / nye)).alias("y"), F.lit(0.0).alias("z"))


def plate_elements(spark: SparkSession, nxe: int, nye: int) -> DataFrame:
    """(elem, lnode, node): quads in tensor order."""
    nnx, first = nxe + 1, F.floor(F.col("id") / nxe) * (nxe + 1) + F.col("id") % nxe
    corners = F.array(*[(first + d).cast("long") for d in (0, 1, nnx, nnx + 1)])
    return spark.range(nxe * nye).select(F.col("id").alias("elem"), F.posexplode(corners).alias("lnode", "node"))


def plate_bcs(nodes: DataFrame, nxe: int, nye: int) -> DataFrame:
    """(dof): simply supported edges of a plate, a corner held in full."""
    ix, iy, none = F.col("ix"), F.col("iy"), F.array().cast("array<int>")
    held = lambda cond, *d: F.when(cond, F.array(*map(F.lit, d))).otherwise(none)
    dofs = F.array_union(
        F.array_union(held((ix == 0) & (iy == 0), 0, 1, 2, 3, 4, 5), held(iy == 0, 1, 2)),
        F.array_union(held(ix == 0, 0, 2), held((ix == nxe) | (iy == nye), 2)),
    )
    return nodes.select("node", F.explode(dofs).alias("d")).select((F.col("node") * 6 + F.col("d")).alias("dof"))


def plate_loads(nodes: DataFrame, q: float, lx: float, ly: float, nxe: int, nye: int, area_weighted: bool = True) -> DataFrame:
    """(dof, val) for all dofs: Q sin(pi x / Lx) sin(pi y / Ly) on w; times each node's area unless told otherwise."""
    area = lx / nxe * (ly / nye) if area_weighted else 1.0
    w = F.sin(pi * F.col("x") / lx) * F.sin(pi * F.col("y") / ly) * (q * area)
    dofs = nodes.select("node", w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("d"))
    return dofs.select((F.col("node") * 6 + F.col("d")).alias("dof"), F.when(F.col("d") == 2, F.col("w")).otherwise(0.0).alias("val"))


def point_load(nodes: DataFrame, nnx: int, nny: int) -> DataFrame:
    """(dof, val): a unit w-load at the node (nnx / 2, nny / 2)."""
    at = (nnx // 2) + nnx * (nny // 2)
    return nodes.filter(F.col("node") == at).select((F.col("node") * 6 + 2).alias("dof"), F.lit(1.0).alias("val"))


def uniform_load(nodes: DataFrame, fz: float = 10.0) -> DataFrame:
    return nodes.select((F.col("node") * 6 + 2).alias("dof"), F.lit(float(fz)).alias("val"))


def grid_points(spark: SparkSession, nnx: int, nny: int, lx: float = 1.0, ly: float = 1.0, z0: float = 0.0) -> DataFrame:
    """(id, x, y, z): a grid with z = z0 sin(pi x / Lx) sin(pi y / Ly)."""
    x, y = (F.col("id") % nnx) * (lx / (nnx - 1)), F.floor(F.col("id") / nnx) * (ly / (nny - 1))
    return spark.range(nnx * nny).select("id", x.alias("x"), y.alias("y")).withColumn("z", z0 * F.sin(pi * F.col("x") / lx) * F.sin(pi * F.col("y") / ly))


def shear_field(points: DataFrame, degrees: float) -> DataFrame:
    """(id, x, y, z): in-plane shear by an angle."""
    t = tan(radians(degrees) / 2)
    return points.select("id", (t * F.col("y")).alias("x"), (t * F.col("x")).alias("y"), F.lit(0.0).alias("z"))


def wavy_field(points: DataFrame, scale: float) -> DataFrame:
    """(id, x, y, z): a smooth trigonometric field."""
    x, y = F.col("x"), F.col("y")
    return points.select("id", (scale * F.sin(2 * pi * x) * F.cos(pi * y)).alias("x"), (scale * F.cos(pi * x) * F.sin(2 * pi * y)).alias("y"), (scale * F.sin(pi * x) * F.sin(pi * y)).alias("z"))


def random_connectivity(spark: SparkSession, n_elems: int, n_nodes: int, per_elem: int, seed: int = 0) -> DataFrame:
    """(elem, lnode, node): distinct nodes for each element, the same on every run.

    An element draws places from a hash; it takes the first `per_elem` distinct ones
    of four times as many and fills up with the nodes after them if those collide.
    """
    draws = F.transform(F.sequence(F.lit(0), F.lit(4 * per_elem - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(n_nodes)))
    more = F.transform(F.sequence(F.lit(0), F.lit(per_elem - 1)), lambda i: F.pmod(F.col("id") + i, F.lit(n_nodes)))
    nodes = F.slice(F.array_distinct(F.concat(draws, more)), 1, per_elem)
    return spark.range(n_elems).select(F.col("id").alias("elem"), F.posexplode(nodes).alias("lnode", "node"))


def random_vector(index: DataFrame, largest: float = 1.0, seed: int = 0, key: str = "dof") -> DataFrame:
    """(key, val): values in [0, largest) by a hash of the key, the same for any partitioning."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 53)) / float(1 << 53)
    return index.select(key, (share * largest).alias("val"))


def one_element(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, elem_nodes) of one quad with coordinates 1.0345452 + 2.23123432 i + 0.323 i^2, i from 0 to 11."""
    c = lambda d: F.expr(f"1.0345452D + 2.23123432D * (3 * id + {d}) + 0.323D * (3 * id + {d}) * (3 * id + {d})")
    nodes = spark.range(4).select(F.col("id").alias("node"), c(0).alias("x"), c(1).alias("y"), c(2).alias("z"))
    return nodes, spark.range(4).select(F.lit(0).cast("long").alias("elem"), F.col("id").cast("int").alias("lnode"), F.col("id").alias("node"))


def annulus_bulk_data(n_radial: int, order: int = 2, inner: float = 4.0, outer: float = 10.0) -> str:
    """Text of a bulk data file: a quarter ring of quads (order 2: 4 nodes, 3: 9 nodes), its inner edge held."""
    from math import cos, sin

    step = order - 1
    ny, nx = step * n_radial + 1, step * int(1.8 * n_radial) + 1
    out, ident = ["SOL 103", "CEND", "BEGIN BULK"], lambda i, j: i + nx * j + 1
    for j in range(ny):
        r = inner + (outer - inner) * j / (ny - 1)
        for i in range(nx):
            a = pi / 2 * i / (nx - 1)
            out += [f"{'GRID*':<8}{ident(i, j):16d}{'':16}{r * cos(a):16.9f}{r * sin(a):16.9f}", f"{'*':<8}{0.0:16.9f}"]
    elem = 0
    for j in range(0, ny - 1, step):
        for i in range(0, nx - 1, step):
            elem += 1
            if order == 2:
                ns = [ident(i, j), ident(i + 1, j), ident(i + 1, j + 1), ident(i, j + 1)]
                out.append(f"{'CQUAD4':<8}" + "".join(f"{v:8d}" for v in (elem, 1, *ns)))
            else:
                ns = [ident(i + a, j + b) for a, b in ((0, 0), (2, 0), (2, 2), (0, 2), (1, 0), (2, 1), (1, 2), (0, 1), (1, 1))]
                fields = [elem, 1, *ns]
                out += [f"{'CQUAD9':<8}" + "".join(f"{v:8d}" for v in fields[:8]), f"{'':<8}" + "".join(f"{v:8d}" for v in fields[8:])]
    out += [f"{'SPC':<8}{1:8d}{ident(i, 0):8d}{'123456':>8}{0.0:8.6f}" for i in range(nx)]
    return "\n".join([*out, "END BULK", ""])
