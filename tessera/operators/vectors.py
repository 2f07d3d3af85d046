"""Vectors as tables: gather, scatter-add, constraints, permutations, reductions.

A vector is (dof, val) or (node, dof, val); an element table is (elem, lnode, node).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(elem_nodes: DataFrame, values: DataFrame) -> DataFrame:
    """Values at each element's nodes: (elem, vals), vals sorted by (lnode, dof).

    An element has a fixed, small number of nodes, so its list is bounded.
    """
    rows = elem_nodes.join(values, "node")
    return rows.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("lnode", "dof", "val"))).alias("vals"))


def scatter_add(contributions: DataFrame, keys: list[str], val: str = "val", scale: float = 1.0) -> DataFrame:
    """Sum of contributions at their destination; partial sums are made before the shuffle."""
    return contributions.groupBy(*keys).agg(F.sum(F.col(val) * scale).alias(val))


def range_slice(df: DataFrame, index: str, start: int, end: int, stride: int = 1) -> DataFrame:
    """Rows whose index is in [start, end) and on the stride."""
    return df.filter((F.col(index) >= start) & (F.col(index) < end) & ((F.col(index) - start) % stride == 0))


def constrain(vec: DataFrame, bcs: DataFrame, value: float = 0.0, key: str = "dof", val: str = "val") -> DataFrame:
    """`vec` with the value at constrained entries; `bcs` has the key column."""
    hit = bcs.select(F.col(key).alias("_bc")).distinct()
    return vec.join(hit, F.col(key) == F.col("_bc"), "left").withColumn(val, F.when(F.col("_bc").isNotNull(), F.lit(value)).otherwise(F.col(val))).drop("_bc")


def global_dof(node: Column, dof: Column, block: int) -> Column:
    return node * block + dof


def permute(vec: DataFrame, perm: DataFrame, block: int = 1) -> DataFrame:
    """(dof, val) with dof = block * node + d moved to block * new + d, by perm (old, new)."""
    moved = vec.join(perm, F.floor(F.col("dof") / block) == F.col("old"))
    return moved.select((F.col("new") * block + F.col("dof") % block).alias("dof"), "val")


def scale(vec: DataFrame, by: float) -> DataFrame:
    return vec.withColumn("val", F.col("val") * by)


def fill(index: DataFrame, value: float = 0.0) -> DataFrame:
    """A constant vector over the rows of `index`."""
    return index.withColumn("val", F.lit(float(value)))


def add(*terms: DataFrame, keys: tuple[str, ...] = ("dof",)) -> DataFrame:
    """Sum of vectors; entries that one lacks are zero there."""
    rows = terms[0].select(*keys, "val")
    for t in terms[1:]:
        rows = rows.unionByName(t.select(*keys, "val"))
    return rows.groupBy(*keys).agg(F.sum("val").alias("val"))


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """a x + y over the entries of y; x may lack some."""
    x = x.select(F.col("dof").alias("_d"), F.col("val").alias("_x"))
    return y.join(x, F.col("dof") == F.col("_d"), "left").select("dof", (F.col("val") + a * F.coalesce("_x", F.lit(0.0))).alias("val"))


def dot(x: DataFrame, y: DataFrame) -> float:
    y = y.select("dof", F.col("val").alias("_y"))
    return x.join(y, "dof").agg(F.sum(F.col("val") * F.col("_y"))).first()[0] or 0.0


def norm(x: DataFrame) -> float:
    return (x.agg(F.sum(F.col("val") * F.col("val"))).first()[0] or 0.0) ** 0.5


def rel_error(a: DataFrame, b: DataFrame, threshold: float = 1e-10) -> DataFrame:
    """One row, rel_error: the largest |(a - b) / (b + 1e-14)| where |b| is over the threshold, else 0."""
    both = a.select("dof", F.col("val").alias("a")).join(b.select("dof", F.col("val").alias("b")), "dof")
    ratio = F.when(F.abs("b") > threshold, F.abs((F.col("a") - F.col("b")) / (F.col("b") + 1e-14)))
    return both.agg(F.coalesce(F.max(ratio), F.lit(0.0)).alias("rel_error"))


def argmax_abs(vec: DataFrame, key: str = "dof", val: str = "val") -> DataFrame:
    """One row (key, val): the signed entry of largest magnitude, the first on ties."""
    best = F.max_by(F.struct(key, val), F.struct(F.abs(val), -F.col(key))).alias("best")
    return vec.agg(best).select("best.*")
