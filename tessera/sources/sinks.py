"""Writers: VTK text, one-line CSV vectors, COO tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# VTK wants quads around their edge, not in tensor order.
QUAD_CYCLE = (0, 1, 3, 2)
QUAD = 9


def vtk_lines(nodes: DataFrame, elem_nodes: DataFrame, moves: DataFrame | None = None, name: str = "disp") -> DataFrame:
    """(part, at, line): a legacy ASCII unstructured grid of quads; sorted by (part, at) it is the file.

    moves: (node, x, y, z); nodes without a row move by 0, and NaN is written as 0.
    """
    spark = nodes.sparkSession
    n, quads = nodes.count(), elem_nodes.select("elem").distinct().count()
    head = ["# vtk DataFile Version 2.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"]
    titles = [(0, i, s) for i, s in enumerate(head)] + [(2, 0, f"CELLS {quads} {5 * quads}"), (4, 0, f"CELL_TYPES {quads}")]
    if moves is not None:
        titles += [(6, 0, f"POINT_DATA {n}"), (6, 1, f"VECTORS {name} double")]
    out = spark.createDataFrame(titles, "part int, at long, line string")
    triple = lambda *c: F.concat_ws(" ", *[F.nanvl(F.col(x), F.lit(0.0)).cast("string") for x in c])
    out = out.unionByName(nodes.select(F.lit(1).alias("part"), F.col("node").alias("at"), triple("x", "y", "z").alias("line")))
    cells = elem_nodes.groupBy("elem").agg(F.map_from_entries(F.collect_list(F.struct("lnode", "node"))).alias("m"))
    corners = [F.col("m")[i].cast("string") for i in QUAD_CYCLE]
    out = out.unionByName(cells.select(F.lit(3).alias("part"), F.col("elem").alias("at"), F.concat_ws(" ", F.lit("4"), *corners).alias("line")))
    out = out.unionByName(cells.select(F.lit(5).alias("part"), F.col("elem").alias("at"), F.lit(str(QUAD)).alias("line")))
    if moves is not None:
        m = nodes.select("node").join(moves.select("node", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "xyz"]), "node", "left")
        m = m.fillna(0.0, ["x", "y", "z"])
        out = out.unionByName(m.select(F.lit(7).alias("part"), F.col("node").alias("at"), triple("x", "y", "z").alias("line")))
    return out


def grid_lines(points: DataFrame, nnx: int, nny: int, moves: DataFrame | None = None) -> DataFrame:
    """(part, at, line): a structured grid of (id, x, y, z) points."""
    n = nnx * nny
    head = ["# vtk DataFile Version 2.0", "grid", "ASCII", "DATASET STRUCTURED_GRID", f"DIMENSIONS {nnx} {nny} 1", f"POINTS {n} double"]
    titles = [(0, i, s) for i, s in enumerate(head)] + ([(2, 0, f"POINT_DATA {n}"), (2, 1, "VECTORS disp double")] if moves is not None else [])
    triple = F.concat_ws(" ", *[F.nanvl(F.col(c), F.lit(0.0)).cast("string") for c in "xyz"])
    out = points.sparkSession.createDataFrame(titles, "part int, at long, line string")
    for part, rows in ((1, points), (3, moves)):
        if rows is not None:
            out = out.unionByName(rows.select(F.lit(part).alias("part"), F.col("id").alias("at"), triple.alias("line")))
    return out


def write_lines(lines: DataFrame, path: str, files: int = 1) -> None:
    """Text files in (part, at) order: one, by one task, or so many pieces that follow each other by name, a task each."""
    lines.repartitionByRange(files, "part", "at").sortWithinPartitions("part", "at").select("line").write.mode("overwrite").text(path)


def csv_vector(vec: DataFrame, key: str = "dof", val: str = "val") -> DataFrame:
    """One row, line: the values in key order, joined by commas. The format is one line, so this is for vectors that fit a row."""
    return vec.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(key, val))), lambda x: x[val].cast("string"))).alias("line"))


def read_csv_vector(spark, path: str) -> DataFrame:
    """(dof, val) of one-line CSV text."""
    parts = spark.read.text(path).filter("value <> ''").select(F.posexplode(F.split("value", ",")).alias("dof", "v"))
    return parts.select(F.col("dof").cast("long").alias("dof"), F.col("v").cast("double").alias("val"))


@F.pandas_udf(StringType())
def _e4(val: pd.Series) -> pd.Series:
    """C's '%.4e' (ties of the exact binary value go to even); format_string rounds the shortest decimal text half up."""
    return pd.Series(np.char.mod("%.4e", val.to_numpy(dtype="float64")).astype(object), index=val.index)


def coo_table(mat: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Entries with '%.4e' text; beside another matrix also its values and the relative error."""
    show = lambda c: F.when(F.col(c).isNotNull(), _e4(F.col(c).cast("double")))
    if other is None:
        return mat.select("row", "col", show("val").alias("value"))
    both = mat.select("row", "col", F.col("val").alias("a")).join(other.select("row", "col", F.col("val").alias("b")), ["row", "col"], "full").fillna(0.0, ["a", "b"])
    error = F.when(F.col("b") == 0, F.abs("a")).otherwise(F.abs((F.col("a") - F.col("b")) / F.col("b")))
    return both.withColumn("e", error).select("row", "col", show("a").alias("a"), show("b").alias("b"), show("e").alias("rel_err"))
