"""Linear solvers on matrix and vector tables: (row, col, val) and (dof, val).

Iterations are joins and sums; each round's vectors are cut to the shared
checkpoint folder, and scalars alone come to the driver. `direct` is for systems
that fit one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tessera.functions import dense
from tessera.operators import elimination, incomplete, sparsity, vectors
from tessera.session import cut

#: Unknowns of the largest system that is solved densely in one task.
DIRECT_LIMIT = 6000
#: Numbers that `banded` may hold: unknowns times bandwidth.
BAND_LIMIT = 1 << 27


class NotConvergedError(RuntimeError):
    """An iteration that ran out of rounds: `rounds`, `residual` (as a share of the first one) and the last iterate `x`."""

    def __init__(self, rounds: int, residual: float, x: DataFrame):
        super().__init__(f"residual {residual:.3g} of the first one after {rounds} rounds")
        self.rounds, self.residual, self.x = rounds, residual, x


def direct(mat: DataFrame, rhs: DataFrame, limit: int = DIRECT_LIMIT) -> DataFrame:
    """(dof, val) by dense elimination with pivoting in one task; raises beyond `limit` unknowns."""
    n = rhs.count()
    if n > limit:
        raise ValueError(f"{n} unknowns; direct() takes {limit} at most, use banded(), cg() or gmres()")
    rows = mat.select("row", "col", "val").unionByName(rhs.select(F.col("dof").alias("row"), F.lit(-1).cast("long").alias("col"), "val"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf["col"] == -1
        dofs = np.sort(pdf.loc[of, "row"].to_numpy())
        b = pdf[of].groupby("row")["val"].sum().reindex(dofs).to_numpy()
        a = np.zeros((len(dofs), len(dofs)))
        m = pdf[~of]
        np.add.at(a, (np.searchsorted(dofs, m["row"]), np.searchsorted(dofs, m["col"])), m["val"])
        return pd.DataFrame({"dof": dofs, "val": np.linalg.solve(a, b)})

    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(solve, "dof long, val double")


def factored(mat: DataFrame, rhs: DataFrame, limit: int = DIRECT_LIMIT) -> DataFrame:
    """(dof, val) by elimination whatever the size: dense in one task up to `limit` unknowns, by the multifrontal solver beyond."""
    return direct(mat, rhs, limit) if rhs.count() <= limit else elimination.multifrontal(mat, rhs)


def banded(mat: DataFrame, rhs: DataFrame, limit: int = BAND_LIMIT, border: DataFrame | None = None) -> DataFrame:
    """(dof, val) by block elimination over the band of a Cuthill-McKee order, in one task.

    The unknowns are cut into blocks as wide as the band, so that the matrix has
    blocks beside its diagonal only; pivots are sought inside a block. Unknowns of
    `border` (dof), few that touch many others, stay out of the band: it is solved for
    their columns too, and they follow from their Schur complement. Memory is
    unknowns times bandwidth and border, which is checked against `limit`; the entries must fit
    the task too. Raises LinAlgError if a block is singular.
    """
    rows = mat.select("row", "col", "val").unionByName(rhs.select(F.col("dof").alias("row"), F.lit(-1).cast("long").alias("col"), "val"))
    if border is not None:
        rows = rows.unionByName(border.select(F.col("dof").alias("row"), F.lit(-2).cast("long").alias("col"), F.lit(0.0).alias("val")))

    def solve(whole: pa.Table) -> pa.Table:
        r, c, v = (whole.column(k).to_numpy() for k in ("row", "col", "val"))
        of, entry = c == -1, c >= 0
        dofs = np.unique(r[of])
        outer = np.zeros(len(dofs), bool)
        outer[np.searchsorted(dofs, r[c == -2])] = True
        n, k = int((~outer).sum()), int(outer.sum())
        at = np.where(outer, n + np.cumsum(outer) - 1, np.cumsum(~outer) - 1)  # the border last
        b = np.zeros(n + k)
        np.add.at(b, at[np.searchsorted(dofs, r[of])], v[of])
        i, j, v = at[np.searchsorted(dofs, r[entry])], at[np.searchsorted(dofs, c[entry])], v[entry]
        inner = (i < n) & (j < n)
        place = np.concatenate((dense.band_order(i[inner], j[inner], n), np.arange(n, n + k)))
        i, j, back = place[i], place[j], np.empty(n + k, np.int64)
        back[place] = np.arange(n + k)
        width = max(1, int(np.abs(i[inner] - j[inner]).max(initial=0)))
        if (width + k) * (n + k) > limit:
            raise ValueError(f"{n + k} unknowns with a bandwidth of {width}; use cg() or gmres()")
        b = b[back]
        sides, low, corner = np.zeros((n, k + 1)), np.zeros((k, n)), np.zeros((k, k))
        right, below, both = (i < n) & (j >= n), (i >= n) & (j < n), (i >= n) & (j >= n)
        np.add.at(sides, (i[right], j[right] - n), v[right])
        np.add.at(low, (i[below] - n, j[below]), v[below])
        np.add.at(corner, (i[both] - n, j[both] - n), v[both])
        sides[:, k] = b[:n]
        x = dense.block_solve(i[inner], j[inner], v[inner], sides, width) if n else sides
        y = np.linalg.solve(corner - low @ x[:, :k], b[n:] - low @ x[:, k]) if k else b[n:]
        found = np.concatenate((x[:, k] - x[:, :k] @ y, y))
        return pa.table({"dof": dofs, "val": found[place[at]]})

    return rows.groupBy(F.lit(0).alias("g")).applyInArrow(solve, "dof long, val double")


def residual(mat: DataFrame, x: DataFrame, rhs: DataFrame) -> DataFrame:
    """(dof, val): A x - b."""
    return vectors.add(sparsity.spmv(mat, x), vectors.scale(rhs, -1.0))


def largest_residual(mat: DataFrame, x: DataFrame, rhs: DataFrame) -> DataFrame:
    """One row (dof, val): the signed entry of A x - b of largest magnitude."""
    return vectors.argmax_abs(residual(mat, x, rhs))


def jacobi(mat: DataFrame):
    """A function r -> r over the diagonal."""
    diag = cut(mat.filter("row = col").select(F.col("row").alias("_d"), F.col("val").alias("_v")))
    return lambda r: r.join(diag, F.col("dof") == F.col("_d")).select("dof", (F.col("val") / F.col("_v")).alias("val"))


def triangular(mat: DataFrame, lower: bool, unit: bool, block: int | None = None):
    """A function r -> x with T x = r, for a triangular (row, col, val), by levels of blocks of consecutive rows.

    A block is solved in one task and waits for the blocks that its entries name; levels
    are found once, each solve does one join a level. A long chain of dependencies, as in a
    band, so takes as many rounds as it crosses blocks. `block`: rows of a block, by
    default so many that a block has about incomplete.ENTRIES entries. Rows that r lacks count as 0.
    """
    own = cut(mat.filter("row >= col" if lower else "row <= col").select("row", "col", "val"))
    if unit:
        own = own.filter("row <> col").unionByName(own.select("row").distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("val")))
    block = block or incomplete.block_rows(own)
    return incomplete.substituted(incomplete.chunked(own, block), (lower,), block, unit_lower=False)


def ilu(mat: DataFrame, levels: DataFrame, block: int = incomplete.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(L, U) of the incomplete factorisation on the pattern of `levels` (row, col, ...), by levels of block rows."""
    return incomplete.split(incomplete.factors(mat, levels, block))


def ilu_preconditioner(mat: DataFrame, levels: DataFrame, block: int = incomplete.BLOCK):
    """A function r -> x with L U x = r; see `incomplete`. Rows that r lacks count as 0; raises ZeroDivisionError if a pivot is missing or 0."""
    return incomplete.applied(incomplete.factors(mat, levels, block), block)


def _kept(mat: DataFrame) -> DataFrame:
    """The matrix once by its columns, so that products of later rounds move the vector only; the caller unpersists it."""
    parts = int(mat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(mat.select("row", "col", "val")).repartition(parts, "col").persist(StorageLevel.DISK_ONLY)


def cg(mat: DataFrame, rhs: DataFrame, precondition=None, tol: float = 1e-10, max_rounds: int = 500, history: list | None = None) -> DataFrame:
    """(dof, val) by preconditioned conjugate gradients for a symmetric positive matrix; stops at |r| < tol |r0|.

    All vectors are columns of one table (dof, x, r, u, p, s). With u = M^-1 r and w = A u,
    both scalars of a round come from (r, u), (w, u) of one aggregate: A p and p obey
    s = w + beta s, p = u + beta p. A round is one product, one write and that aggregate.
    Without `precondition`, M is the diagonal. Raises NotConvergedError after max_rounds.
    history: gets (round, |r|) of each round.
    """
    kept = _kept(mat)
    try:
        start = rhs.select("dof", F.lit(0.0).alias("x"), F.col("val").alias("r"), F.lit(0.0).alias("p"), F.lit(0.0).alias("s"))
        if precondition is None:
            diag = mat.filter("row = col").select(F.col("row").alias("dof"), F.col("val").alias("m"))
            start = start.join(diag, "dof", "left")
        state, first, before, alpha, now = cut(start), None, None, 1.0, 0.0
        for k in range(max_rounds + 1):
            if precondition is None:
                state = state.withColumn("u", F.col("r") / F.col("m"))
            else:
                state = state.join(precondition(state.select("dof", F.col("r").alias("val"))).select("dof", F.col("val").alias("u")), "dof")
            state = cut(state) if precondition else state
            product = sparsity.spmv(kept, state.select("dof", F.col("u").alias("val"))).select("dof", F.col("val").alias("w"))
            state = cut(state.join(product, "dof", "left").fillna(0.0, ["w"]))
            gamma, delta, size = state.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)) for a, b in ("ru", "wu", "rr")]).first()
            now = size**0.5
            first = now if first is None else first
            if history is not None and k:
                history.append((k, now))
            if now == 0 or gamma == 0 or now < tol * first:
                return state.select("dof", F.col("x").alias("val"))
            beta = 0.0 if before is None else gamma / before
            alpha = gamma / (delta - beta * gamma / alpha)
            before = gamma
            p, s = F.col("u") + beta * F.col("p"), F.col("w") + beta * F.col("s")
            state = state.withColumns({"p": p, "s": s}).withColumns({"x": F.col("x") + alpha * F.col("p"), "r": F.col("r") - alpha * F.col("s")}).drop("u", "w")
    finally:
        kept.unpersist()
    raise NotConvergedError(max_rounds, now / first, state.select("dof", F.col("x").alias("val")))


def gmres(mat: DataFrame, rhs: DataFrame, precondition=None, restart: int = 30, tol: float = 1e-10, max_cycles: int = 20, history: list | None = None) -> DataFrame:
    """(dof, val) by restarted GMRES, preconditioned from the left; stops at |M^-1 r| < tol |M^-1 b|.

    The basis is an array column `v` of one table, so a new vector is made orthogonal to
    all earlier ones by two aggregates (classical Gram-Schmidt, done twice), whatever
    their number. The small Hessenberg matrix is on the driver. Raises
    NotConvergedError after max_cycles. history: gets (round, |M^-1 r|) of each round.
    """
    precondition = precondition or (lambda r: r)
    kept = _kept(mat)
    try:
        x, scale, rounds, last = vectors.fill(rhs.select("dof")), None, 0, 0.0
        for _ in range(max_cycles):
            r = cut(precondition(vectors.scale(residual(kept, x, rhs), -1.0)))
            beta = vectors.norm(r)
            scale = beta if scale is None else scale  # of x = 0: that of b
            last = beta
            if scale == 0 or beta < tol * scale:
                return x
            basis = r.select("dof", F.array(F.col("val") / beta).alias("v"))
            h = np.zeros((restart + 1, restart))
            for j in range(restart):
                w = precondition(sparsity.spmv(kept, basis.select("dof", F.element_at("v", -1).alias("val")))).select("dof", F.col("val").alias("w"))
                both = cut(basis.join(w, "dof", "left").fillna(0.0, ["w"]))
                for _again in range(2):
                    size, dots = _dots(both, j + 1)
                    h[: j + 1, j] += dots
                    both = both.withColumn("w", F.col("w") - F.aggregate(F.zip_with("v", F.array(*map(F.lit, dots.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
                # what the second pass takes off is small, so the rest's norm follows from the one before it
                h[j + 1, j] = max(size - dots @ dots, 0.0) ** 0.5
                y, rest = _least(h, j + 1, beta)
                rounds += 1
                if history is not None:
                    history.append((rounds, rest))
                if rest < tol * scale or h[j + 1, j] < 1e-14 * beta:
                    break
                basis = both.select("dof", F.concat("v", F.array(F.col("w") / float(h[j + 1, j]))).alias("v"))
            steps = F.zip_with(F.slice("v", 1, len(y)), F.array(*map(F.lit, y.tolist())), lambda a, b: a * b)
            step = both.select("dof", F.aggregate(steps, F.lit(0.0), lambda a, b: a + b).alias("step"))
            x = cut(x.join(step, "dof", "left").select("dof", (F.col("val") + F.coalesce("step", F.lit(0.0))).alias("val")))
        if (last := vectors.norm(cut(precondition(residual(kept, x, rhs))))) < tol * scale:
            return x
    finally:
        kept.unpersist()
    raise NotConvergedError(rounds, last / scale, x)


def _dots(both: DataFrame, n: int) -> tuple[float, np.ndarray]:
    """The product of w with itself, and those with the n vectors of v: one aggregate, of the same code whatever n."""
    parts = both.select("w", F.posexplode(F.concat("v", F.array("w"))).alias("i", "x")).groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    found = {r.i: r.dot for r in parts.collect()}
    return found.get(n, 0.0), np.array([found.get(i, 0.0) for i in range(n)])


def _least(h: np.ndarray, size: int, beta: float) -> tuple[np.ndarray, float]:
    e = np.zeros(size + 1)
    e[0] = beta
    y = np.linalg.lstsq(h[: size + 1, :size], e, rcond=None)[0]
    return y, float(np.linalg.norm(e - h[: size + 1, :size] @ y))
