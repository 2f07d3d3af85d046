"""Unstructured meshes in the SU2 text format as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import topology

# Cell codes and their types and sizes.
CELLS = {5: ("tri", 3), 9: ("quad", 4), 10: ("tet", 4), 12: ("hex", 8), 13: ("wedge", 6), 14: ("pyramid", 5)}
SIDES = {3: ("line", 2), 5: ("tri", 3), 9: ("quad", 4)}


@dataclass
class Mesh:
    dimension: int
    nodes: DataFrame  # node, x, y, z
    elements: DataFrame  # elem, etype, lnode, node
    boundary: DataFrame  # tag, bface, etype, verts

    def boundary_names(self) -> DataFrame:
        return self.boundary.select("tag").distinct()

    def boundary_nodes(self) -> DataFrame:
        """(tag, node): distinct nodes of each boundary."""
        return self.boundary.select("tag", F.explode("verts").alias("node")).distinct()

    def connectivity(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(edges, faces, boundary match); of a flat mesh the faces are its cells' edges."""
        edges = topology.edges(self.elements)
        faces = topology.faces(self.elements) if self.dimension == 3 else edges.withColumnRenamed("edge", "face")
        return edges, faces, topology.boundary(faces, self.boundary.select("tag", "bface", "verts"))

    def summary(self) -> DataFrame:
        """(kind, name, n): elements by type, and boundary faces by tag."""
        by_type = topology.summary(self.elements).select(F.lit("element").alias("kind"), F.col("etype").alias("name"), "n")
        return by_type.unionByName(self.boundary.groupBy("tag").agg(F.count("*").alias("n")).select(F.lit("boundary").alias("kind"), F.col("tag").alias("name"), "n"))


def read(spark: SparkSession, path: str) -> Mesh:
    """Tables of one file; cells of other codes are left out. A path that cannot be read raises.

    The file is one row until its lines are exploded, because sections are told by
    the lines before.
    """
    from tessera.session import cut

    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    rows = text.select("line_no", F.trim(F.regexp_replace("line", "%.*", "")).alias("line")).filter("line <> ''")
    key = F.regexp_extract("line", r"^([A-Z_]+)\s*=", 1)
    value = F.trim(F.regexp_extract("line", r"=\s*(.*)$", 1))
    so_far = Window.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("key", F.when(key != "", key)).withColumn("value", F.when(key != "", value))
    rows = rows.withColumn("section", F.last("key", True).over(so_far)).withColumn("tag", F.last(F.when(F.col("key") == "MARKER_TAG", F.col("value")), True).over(so_far))
    rows = cut(rows.withColumn("at", F.row_number().over(Window.partitionBy("section", "tag").orderBy("line_no"))))
    dimension = int(rows.filter("key = 'NDIME'").first()["value"])
    data = rows.filter("key is null").withColumn("f", F.split("line", r"\s+"))
    points = data.filter("section = 'NPOIN'").withColumn("node", F.row_number().over(Window.orderBy("line_no")).cast("long") - 1)
    coord = lambda i: F.col("f")[i].cast("double") if i < dimension else F.lit(0.0)
    nodes = points.select("node", coord(0).alias("x"), coord(1).alias("y"), coord(2).alias("z"))
    cells = _cells(data.filter("section = 'NELEM'"), CELLS)
    order = F.lit(len(topology.TYPE_ORDER))
    for i, t in enumerate(topology.TYPE_ORDER):
        order = F.when(F.col("etype") == t, i).otherwise(order)
    cells = cells.withColumn("elem", F.row_number().over(Window.orderBy(order, "line_no")).cast("long") - 1)
    elements = cells.select("elem", "etype", F.posexplode("verts").alias("lnode", "node"))
    sides = _cells(data.filter("section = 'MARKER_ELEMS'"), SIDES)
    sides = sides.withColumn("bface", F.row_number().over(Window.partitionBy("tag").orderBy("line_no")).cast("long") - 1)
    return Mesh(dimension, cut(nodes), cut(elements), cut(sides.select("tag", "bface", "etype", "verts")))


def _cells(data: DataFrame, codes: dict[int, tuple[str, int]]) -> DataFrame:
    code, etype, size = F.col("f")[0].cast("int"), F.lit(None).cast("string"), F.lit(0)
    for c, (name, n) in codes.items():
        etype, size = F.when(code == c, name).otherwise(etype), F.when(code == c, n).otherwise(size)
    return data.withColumn("etype", etype).filter("etype is not null").select("line_no", "tag", "etype", F.transform(F.slice("f", F.lit(2), size), lambda x: x.cast("long")).alias("verts"))
