"""Multi-point and periodic constraints: tied dofs are sums of others, and leave the system.

Ties are (dof, master, coef): a dof equals the sum of its masters times coefs. Masters
may be tied themselves; chains are resolved by squaring the table, so the rounds are
the logarithm of the longest chain. With T the resolved table, the system T' K T is in
free dofs only, made by two joins, each with partial sums before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sparsity
from tessera.session import cut


class CycleError(ValueError):
    """Dofs that are tied to themselves over others."""


def resolved(ties: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(row, col, val): tied dofs by free ones. Repeats are added; a dof that is tied is so in all its rows. Raises CycleError."""
    t = cut(ties.groupBy(F.col("dof").alias("row"), F.col("master").alias("col")).agg(F.sum("coef").cast("double").alias("val")))
    for _ in range(max_rounds):
        tied = t.select(F.col("row").alias("_t")).distinct()
        if not t.join(tied, F.col("col") == F.col("_t"), "left_semi").take(1):
            return t
        if t.filter("row = col").take(1):
            break
        step = t.select(F.col("row").alias("col"), F.col("col").alias("_c"), F.col("val").alias("_v"))
        t = t.join(step, "col", "left").select("row", F.coalesce("_c", "col").alias("col"), (F.col("val") * F.coalesce("_v", F.lit(1.0))).alias("val"))
        t = cut(t.groupBy("row", "col").agg(F.sum("val").alias("val")))
    raise CycleError("dofs are tied in a cycle")


def condensed(mat: DataFrame, t: DataFrame) -> DataFrame:
    """T' K T as (row, col, val), for the resolved table `t`; dofs without a tie stand for themselves. Only rows of `t` are moved twice."""
    half = _put(mat, t, "col")
    return _put(half, t, "row")


def eliminated(mat: DataFrame, dofs: DataFrame) -> DataFrame:
    """The system without `dofs` (dof), which are not joined with each other: K - k k' / d for the column k, row k' and diagonal d of each. A dof without a diagonal raises in the task."""
    gone = cut(dofs.select("dof").distinct())
    inner = lambda rows, name: rows.join(gone, F.col(name) == F.col("dof"), "left_anti")
    outer = lambda rows, name: rows.join(gone, F.col(name) == F.col("dof"), "left_semi")
    left = inner(outer(mat, "col"), "row").select("row", F.col("col").alias("_h"), F.col("val").alias("_l"))
    up = inner(outer(mat, "row"), "col").select(F.col("row").alias("_h"), "col", F.col("val").alias("_u"))
    diag = outer(mat, "row").filter("row = col").select(F.col("row").alias("_h"), F.col("val").alias("_d"))
    pivot = F.coalesce("_d", F.raise_error(F.lit("a dof to eliminate has no diagonal")).cast("double"))
    fill = left.join(up, "_h").join(diag, "_h", "left").select("row", "col", (-F.col("_l") * F.col("_u") / pivot).alias("val"))
    return inner(inner(mat, "row"), "col").select("row", "col", "val").unionByName(fill).groupBy("row", "col").agg(F.sum("val").alias("val"))


def condensed_load(rhs: DataFrame, t: DataFrame) -> DataFrame:
    """T' f as (dof, val)."""
    return _put(rhs, t, "dof")


def expanded(x: DataFrame, t: DataFrame) -> DataFrame:
    """All dofs' values from those of the free ones: (dof, val)."""
    return x.select("dof", "val").unionByName(sparsity.spmv(t, x))


def _put(rows: DataFrame, t: DataFrame, name: str) -> DataFrame:
    own = t.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("val").alias("_v"))
    moved = rows.join(own, F.col(name) == F.col("_r"), "left")
    keys = [c for c in rows.columns if c != "val"]
    moved = moved.select(*[F.coalesce("_c", c).alias(c) if c == name else c for c in keys], (F.col("val") * F.coalesce("_v", F.lit(1.0))).alias("val"))
    return moved.groupBy(*keys).agg(F.sum("val").alias("val"))
