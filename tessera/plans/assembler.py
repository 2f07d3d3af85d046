"""Assembly of shell and plane-stress models: gather, element kernel, scatter-add."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import shell, triangle
from tessera.operators import ordering, solvers, sparsity, vectors
from tessera.sources.bdf import BulkData

#: (coordinates (E, nodes, 3), material columns) -> (E, n, n) matrices
Kernel = Callable[[np.ndarray, pd.DataFrame], np.ndarray]


def shell_kernel(ref_axis: tuple[float, float, float] | None = None, mixed: bool = True) -> Kernel:
    axis = None if ref_axis is None else np.array(ref_axis, float)
    return lambda x, m: shell.stiffness(x, m["E"].to_numpy(), m["nu"].to_numpy(), m["thick"].to_numpy(), m["t_offset"].to_numpy(), axis, mixed)


def triangle_kernel() -> Kernel:
    """Six-node plane-stress triangles: corners are the first three nodes; two dofs a node."""
    return lambda x, m: triangle.stiffness(x[:, :3, :2], m["E"].to_numpy(), m["nu"].to_numpy(), m["thick"].to_numpy())


@dataclass
class Assembler:
    """A model: nodes (node, x, y, z), elem_nodes (elem, lnode, node), material (elem, E, nu, thick, t_offset), bcs (dof).

    Any element whose kernel gives a matrix over (lnode, dof) plugs in.
    """

    nodes: DataFrame
    elem_nodes: DataFrame
    material: DataFrame
    bcs: DataFrame
    kernel: Kernel = field(default_factory=shell_kernel)
    dofs: int = 6

    @classmethod
    def from_bulk_data(cls, data: BulkData, E: float = 70e9, nu: float = 0.3, thick: float = 0.005, **more) -> Assembler:  # noqa: N803
        return cls(data.nodes, data.elem_nodes, uniform_material(data.elems.select("elem"), E, nu, thick), data.bcs(), **more)

    def _gathered(self) -> DataFrame:
        """(elem, ns, E, nu, thick, t_offset): nodes and places of each element, a bounded list."""
        at = self.elem_nodes.join(self.nodes, "node")
        packed = at.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("lnode", "node", "x", "y", "z"))).alias("ns"))
        return packed.join(self.material, "elem")

    def _element_rows(self, make, schema: str, extra: DataFrame | None = None) -> DataFrame:
        """make(nodes (E, n), matrices, batch) -> columns of the output rows."""
        kernel = self.kernel

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                sizes = pdf["ns"].map(len)
                for n in sorted(sizes.unique()):  # elements of one kind at a time
                    part = pdf[sizes == n]
                    for lo in range(0, len(part), 512):
                        b = part.iloc[lo : lo + 512]
                        x = np.array([[(p["x"], p["y"], p["z"]) for p in row] for row in b["ns"]])
                        ids = np.array([[p["node"] for p in row] for row in b["ns"]])
                        yield make(ids, kernel(x, b), b)

        rows = self._gathered()
        return (rows if extra is None else rows.join(extra, "elem")).mapInPandas(run, schema)

    def matrix(self) -> DataFrame:
        """(row, col, val): the stiffness, with element contributions summed."""
        d = self.dofs

        def triples(ids: np.ndarray, k: np.ndarray, _) -> pd.DataFrame:
            dof = (ids[:, :, None] * d + np.arange(d)).reshape(len(ids), -1)
            return pd.DataFrame({"row": np.repeat(dof, dof.shape[1], axis=1).ravel(), "col": np.tile(dof, (1, dof.shape[1])).ravel(), "val": k.ravel()})

        parts = self._element_rows(triples, "row long, col long, val double")
        return vectors.scatter_add(parts, ["row", "col"])

    def element_results(self, variables: DataFrame) -> DataFrame:
        """(elem, energy, res): energy and residual (dof, val) of each element for (dof, val) variables."""
        d = self.dofs
        by_node = variables.select(F.floor(F.col("dof") / d).alias("node"), (F.col("dof") % d).alias("dof"), "val")
        q = vectors.gather(self.elem_nodes, by_node)

        def act(ids: np.ndarray, k: np.ndarray, b: pd.DataFrame) -> pd.DataFrame:
            v = np.array([[x["val"] for x in row] for row in b["vals"]])
            r = np.einsum("eij,ej->ei", k, v)
            dof = (ids[:, :, None] * d + np.arange(d)).reshape(len(ids), -1)
            res = [[{"dof": int(i), "val": float(x)} for i, x in zip(a, c, strict=True)] for a, c in zip(dof, r, strict=True)]
            return pd.DataFrame({"elem": b["elem"].to_numpy(), "energy": 0.5 * np.einsum("ei,ei->e", v, r), "res": res})

        return self._element_rows(act, "elem long, energy double, res array<struct<dof:long,val:double>>", q)

    def energy(self, variables: DataFrame) -> float:
        return self.element_results(variables).agg(F.sum("energy")).first()[0] or 0.0

    def residual(self, variables: DataFrame) -> DataFrame:
        """(dof, val): K q, summed over elements."""
        rows = self.element_results(variables).select(F.explode("res").alias("r")).select("r.*")
        return vectors.scatter_add(rows, ["dof"])

    def node_pattern(self) -> DataFrame:
        return sparsity.pattern(self.elem_nodes)

    def symbolic_factorization(self, order: bool = True) -> tuple[DataFrame, DataFrame]:
        """(perm, filled pattern with levels): RCM order (or none) and full fill."""
        pat = self.node_pattern()
        perm = ordering.rcm(pat) if order else ordering.identity(pat.select(F.col("row").alias("node")).distinct())
        return perm, sparsity.iluk(sparsity.apply_perm(pat, perm), None)

    def zero_vector(self) -> DataFrame:
        each = self.nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(self.dofs - 1))).alias("d"))
        return each.select((F.col("node") * self.dofs + F.col("d")).alias("dof"), F.lit(0.0).alias("val"))

    def solve(self, loads: DataFrame, how: str = "direct", **options) -> DataFrame:
        """(dof, val) with K u = f and held dofs zero; how: direct, banded, cg or gmres."""
        k = sparsity.constrain(self.matrix(), self.bcs)
        f = vectors.constrain(vectors.add(self.zero_vector(), loads), self.bcs)
        return {"direct": solvers.direct, "banded": solvers.banded, "cg": solvers.cg, "gmres": solvers.gmres}[how](k, f, **options)


def uniform_material(elems: DataFrame, E: float, nu: float, thick: float, t_offset: float = 0.0) -> DataFrame:  # noqa: N803
    return elems.select("elem", *[F.lit(float(v)).alias(k) for k, v in (("E", E), ("nu", nu), ("thick", thick), ("t_offset", t_offset))])
