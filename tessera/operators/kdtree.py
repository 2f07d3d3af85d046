"""Exact nearest neighbours by a k-d tree with bounded leaves, for clouds however clustered.

Clouds are (id, x, y, z) with ids told once, as in `transfer`, whose `knn` looks in cubes
of one width for all; there a cluster shares a cube, here leaves shrink with it.
"""

from __future__ import annotations

from functools import reduce
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Points of a leaf, at most.
LEAF_ROWS = 256
#: Node numbers are 64 bits: the root is 1, the children of i are 2 i and 2 i + 1.
DEEPEST = 61
#: Accuracy of the medians: places are right to one in so many.
MEDIAN_ACCURACY = 200


def _far(of: str) -> Column:
    """Squared distance of (x, y, z) from the corner of a box (lo_x, hi_x, ...) that is farthest (`of` = far) or from the box (near)."""
    total = None
    for c in "xyz":
        lo, hi = F.col(c) - F.col(f"lo_{c}"), F.col(c) - F.col(f"hi_{c}")
        step = F.greatest(F.abs(lo), F.abs(hi)) if of == "far" else F.greatest(-lo, hi, F.lit(0.0))
        total = F.pow(step, 2) if total is None else total + F.pow(step, 2)
    return total


def _measured(rows: DataFrame, depth: int, leaf_rows: int) -> DataFrame:
    """(node, n, box, axis, at, closed, splits): the points under each node and where it splits."""
    sides = [f(c).alias(f"{name}_{c}") for c in "xyz" for name, f in (("lo", F.min), ("hi", F.max))]
    medians = [F.percentile_approx(c, 0.5, MEDIAN_ACCURACY).alias(f"mid_{c}") for c in "xyz"]
    stats = rows.filter("is_s").groupBy("node").agg(F.count("*").alias("n"), *sides, *medians)
    widths = F.greatest(*[F.struct((F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias("width"), F.lit(c).alias("axis"), F.col(f"lo_{c}").alias("lo"), F.col(f"mid_{c}").alias("mid")) for c in "xyz"])
    stats = stats.withColumn("w", widths).withColumn("axis", F.when(F.col("w.width") > 0, F.col("w.axis")))
    # a median on the lower side goes with the points below it, so that neither child is empty
    stats = stats.withColumn("at", F.col("w.mid")).withColumn("closed", F.col("w.mid") <= F.col("w.lo"))
    splits = (F.col("n") > leaf_rows) & F.lit(depth < DEEPEST)
    return stats.select("node", "n", *[f"{s}_{c}" for c in "xyz" for s in ("lo", "hi")], "axis", "at", "closed", splits.alias("splits"))


def grown(a_points: DataFrame, s_points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, list[DataFrame]]:
    """((is_s, id, x, y, z, node, r2), boxes by depth): all points in their leaves.

    A level of the tree is one aggregate of boxes and medians and one write of the points
    that go on. A node splits across its longest side; points all in one place are dealt
    by a hash of their ids. The `a` points go the same ways; their r2 bounds the squared
    distance of their k-th neighbour, from the smallest box on the way with k points.
    """
    side = lambda p, s: p.select(F.lit(s).alias("is_s"), "id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    rows = cut(side(s_points, True).unionByName(side(a_points, False)).withColumn("node", F.lit(1).cast("long")).withColumn("r2", F.lit(inf)))
    leaves, boxes = [], []
    while True:
        stats = cut(_measured(rows, len(boxes), leaf_rows))
        boxes.append(stats)
        rows = rows.join(stats, "node", "left").withColumn("r2", F.when(F.col("n") >= k, F.least("r2", _far("far"))).otherwise(F.col("r2")))
        along = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
        upper = F.when(F.col("axis").isNull(), F.pmod(F.xxhash64("id", F.lit(len(boxes))), F.lit(2)) == 1).when(F.col("closed"), along > F.col("at")).otherwise(along >= F.col("at"))
        rows = rows.withColumn("child", F.when(F.col("splits"), 2 * F.col("node") + upper.cast("long")))
        rows = cut(rows.select("is_s", "id", "x", "y", "z", "node", "r2", "child"))
        leaves.append(rows.filter("child is null").drop("child"))
        rows = rows.filter("child is not null").withColumn("node", F.col("child")).drop("child")
        if rows.isEmpty():
            return reduce(DataFrame.union, leaves), boxes


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(a, s, d2, k): of pairs (a, x, y, z, s, sx, sy, sz, r2), the k nearest no farther than r2; ties to the smaller s."""
    d2 = sum((F.pow(F.col(c) - F.col(f"s{c}"), 2) for c in "yz"), F.pow(F.col("x") - F.col("sx"), 2))
    near = pairs.select("a", "s", d2.alias("d2"), "r2").filter("d2 <= r2")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy("d2", "s")) - 1).filter(F.col("k") < k)


def knn(a_points: DataFrame, s_points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(a, k, s, d2): the k nearest s of each a, from k = 0, ties to the smaller id; exact.

    The k-th neighbour inside an a's own leaf bounds its search; then the pairs of an a
    and a box go down the tree, level by level as an equi-join of nodes with the boxes
    of their children, and only boxes that reach into the bound go on. A leaf has at
    most `leaf_rows` points, so no key of the last join is hot on that side. With fewer
    than k points in all, an a gets all of them; points with a null coordinate are near to none.
    """
    points, boxes = grown(a_points, s_points, k, leaf_rows)
    points = cut(points)
    s = points.filter("is_s").select(F.col("id").alias("s"), *[F.col(c).alias(f"s{c}") for c in "xyz"], "node")
    a = points.filter("not is_s").select(F.col("id").alias("a"), "x", "y", "z", "node", "r2")
    own = _ranked(a.join(s, "node"), k).filter(F.col("k") == k - 1).select("a", F.col("d2").alias("own"))
    near = a.drop("node").join(own, "a", "left").withColumn("r2", F.least("r2", "own")).drop("own").withColumn("node", F.lit(1).cast("long"))
    hits = []
    for depth, box in enumerate(boxes):
        box = box.select("node", "splits", *[f"{e}_{c}" for c in "xyz" for e in ("lo", "hi")])
        if depth:
            near = near.withColumnRenamed("node", "parent")
            box = box.withColumn("parent", F.shiftright("node", 1))
        near = near.join(box, "parent" if depth else "node").filter(_far("near") <= F.col("r2"))
        near = cut(near.select("a", "x", "y", "z", "r2", "node", "splits"))
        hits.append(near.filter("not splits").drop("splits"))
        near = near.filter("splits").drop("splits")
    return _ranked(reduce(DataFrame.union, hits).join(s, "node"), k).select("a", F.col("k").cast("int").alias("k"), "s", "d2")
