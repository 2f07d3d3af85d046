"""Edges, faces and boundaries of meshes: (elem, etype, lnode, node) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.prefix import prefix_sum
from tessera.operators.sparsity import dealt, pattern, tasks

# Local nodes of the edges and faces of each element type.
EDGES = {
    "tri": [(1, 2), (2, 0), (0, 1)],
    "quad": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "tet": [(1, 2), (2, 0), (0, 1), (0, 3), (1, 3), (2, 3)],
    "hex": [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
    "pyramid": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
    "wedge": [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
}
FACES = {
    "tet": [(1, 2, 3), (0, 3, 2), (0, 1, 3), (0, 2, 1)],
    "hex": [(0, 4, 7, 3), (1, 2, 6, 5), (0, 1, 5, 4), (3, 7, 6, 2), (0, 3, 2, 1), (4, 5, 6, 7)],
    "pyramid": [(0, 1, 4), (1, 2, 4), (2, 3, 4), (0, 4, 3), (0, 3, 2, 1)],
    "wedge": [(0, 1, 2), (3, 4, 5), (0, 3, 4, 1), (1, 4, 5, 2), (0, 2, 5, 3)],
}
#: Order in which element ids run when meshes of several types are put together.
TYPE_ORDER = ("tet", "hex", "pyramid", "wedge", "tri", "quad")
#: More than the edges or faces of any element.
STRIDE = 16


def combined(meshes: dict[str, DataFrame]) -> DataFrame:
    """One table of meshes of several types, each (elem, lnode, node) with elem from 0."""
    out, offset = None, 0
    for etype in (t for t in TYPE_ORDER if t in meshes):
        m = meshes[etype].select((F.col("elem") + offset).alias("elem"), F.lit(etype).alias("etype"), "lnode", "node")
        out = m if out is None else out.unionByName(m)
        last = meshes[etype].agg(F.max("elem")).first()[0]
        offset += 0 if last is None else last + 1
    return out


def vertex_elements(mesh: DataFrame) -> DataFrame:
    """(node, elems): the elements at each vertex, ascending."""
    return mesh.groupBy("node").agg(F.array_sort(F.collect_set("elem")).alias("elems"))


def _local(spark: SparkSession, table: dict[str, list[tuple]]) -> DataFrame:
    rows = [(t, i, list(nodes)) for t, parts in table.items() for i, nodes in enumerate(parts)]
    return F.broadcast(spark.createDataFrame(rows, "etype string, part int, locals array<int>"))  # a fixed table of a few dozen rows


def _parts(mesh: DataFrame, table: dict[str, list[tuple]]) -> DataFrame:
    """(elem, part, verts): edges or faces of each element in their own orientation."""
    packed = mesh.groupBy("elem", "etype").agg(F.map_from_entries(F.collect_list(F.struct("lnode", "node"))).alias("at"))
    parts = packed.join(_local(mesh.sparkSession, table), "etype")
    return parts.select("elem", "part", F.transform("locals", lambda i: F.col("at")[i]).alias("verts"))


def _numbered(parts: DataFrame, name: str) -> DataFrame:
    """Ids by first appearance over (elem, part) of equal vertex sets."""
    keyed = parts.withColumn("key", F.array_sort("verts"))
    first = keyed.groupBy("key").agg(F.min(F.col("elem") * STRIDE + F.col("part")).alias("_first"))
    ids = prefix_sum(first, "_first", F.lit(1).cast("long"), name).drop("_first")
    return keyed.join(ids, "key").select("elem", "part", "verts", "key", name)


def edges(mesh: DataFrame) -> DataFrame:
    """(elem, part, verts, key, edge): edge ids are the same for the same two vertices."""
    return _numbered(_parts(mesh, EDGES), "edge")


def faces(mesh: DataFrame) -> DataFrame:
    """(elem, part, verts, key, face): face ids are the same for the same set of vertices."""
    return _numbered(_parts(mesh, FACES), "face")


def misoriented(face_table: DataFrame) -> DataFrame:
    """(face, elem_a, elem_b): shared faces that both elements wind the same way.

    Well-numbered neighbours see a shared face in opposite cycles.
    """
    verts = F.col("verts")
    at = F.array_position(verts, F.array_min(verts)).cast("int")
    turned = F.concat(F.slice(verts, at, F.size(verts)), F.slice(verts, 1, at - 1))
    t = face_table.select("face", "elem", turned.alias("cycle"))
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.face") == F.col("b.face")) & (F.col("a.elem") < F.col("b.elem")))
    return pairs.filter("a.cycle = b.cycle").select("a.face", F.col("a.elem").alias("elem_a"), F.col("b.elem").alias("elem_b"))


def boundary(face_table: DataFrame, tagged: DataFrame) -> DataFrame:
    """(tag, bface, elem, part, face, verts) for boundary faces (tag, bface, verts).

    Matched by vertex set; the element with the least id gives its orientation. No
    match: nulls, and the verts as given.
    """
    own = face_table.groupBy("key").agg(F.min_by(F.struct("elem", "part", "face", "verts"), F.struct("elem", "part")).alias("m"))
    hit = tagged.withColumn("key", F.array_sort("verts")).join(own, "key", "left")
    return hit.select("tag", "bface", "m.elem", "m.part", "m.face", F.coalesce("m.verts", "verts").alias("verts"))


def element_graph(mesh: DataFrame, with_diagonal: bool = True) -> DataFrame:
    """(row, col): vertices that share an element."""
    pairs = pattern(mesh)
    return pairs if with_diagonal else pairs.filter("row <> col")


def halo(mesh: DataFrame, elems: DataFrame, layers: int = 2) -> DataFrame:
    """(elem): the given elements and those that hang together with them by vertices, in so many layers.

    The mesh is dealt in tasks of bounded rows by element and by vertex, so that what a
    join sorts in a task does not grow with it.
    """
    n = tasks(mesh)
    ends = mesh.select("elem", "node")
    by_elem, by_node = dealt(ends, n, "elem"), dealt(ends, n, "node")
    owned = dealt(elems.select("elem"), n, "elem").distinct()
    for _ in range(layers):
        near = dealt(by_elem.join(owned, "elem", "left_semi").select("node").distinct(), n, "node")
        owned = dealt(by_node.join(near, "node", "left_semi").select("elem"), n, "elem").distinct()
    return owned


def summary(mesh: DataFrame) -> DataFrame:
    """(etype, n): elements of each type."""
    return mesh.groupBy("etype").agg(F.countDistinct("elem").alias("n"))
