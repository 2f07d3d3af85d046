"""Parts of a graph: a multilevel partitioner, and the tables by which parts exchange values with their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.prefix import prefix_sum
from tessera.operators.dissection import both_ways, sweep
from tessera.operators.ordering import components
from tessera.session import cut

#: A part is at most this much over the mean, and no less under it by moves.
SLACK = 0.05
#: Coarsening goes on while there are more nodes than this for each part, and each round takes away a twentieth at least.
COARSE_NODES = 40
#: Moves in each direction on each level, at most.
MOVES = 8


def _matched(nodes: DataFrame, edges: DataFrame, heaviest: float) -> DataFrame:
    """(node, to): pairs by mutual choice of the heaviest edge, named by the smaller node; the others stay alone.

    Ties go by a hash of the edge that both ends see alike, so of all edges left one at
    least is chosen by both. Pairs heavier than `heaviest` are not made. Nodes left
    without a mate choose once more among each other.
    """
    weights = nodes.select(F.col("node").alias("row"), F.col("w").alias("wr"))
    free = edges.join(weights, "row").join(weights.select(F.col("row").alias("col"), F.col("wr").alias("wc")), "col")
    free = cut(free.filter(F.col("wr") + F.col("wc") <= heaviest).select("row", "col", "w"))
    pairs = None
    for _ in range(2):
        tie = F.xxhash64(F.least("row", "col"), F.greatest("row", "col"))
        choice = cut(free.groupBy("row").agg(F.max_by("col", F.struct("w", tie, F.least("row", "col"), F.greatest("row", "col"))).alias("col")))
        both = choice.join(choice.select(F.col("col").alias("row"), F.col("row").alias("col")), ["row", "col"])
        both = cut(both.select(F.col("row").alias("node"), F.least("row", "col").alias("to")))
        pairs = both if pairs is None else pairs.union(both)
        taken = both.select(F.col("node").alias("row"))
        free = cut(free.join(taken, "row", "left_anti").join(taken.withColumnRenamed("row", "col"), "col", "left_anti").select("row", "col", "w"))
    return cut(nodes.select("node").join(pairs, "node", "left").select("node", F.coalesce("to", "node").alias("to")))


def _spread(nodes: DataFrame, edges: DataFrame, parts: int, total: int) -> DataFrame:
    """(node, w, part): equal shares of the weight along each component, in the better of two orders.

    Of three nodes far from each other: by distance from the second, and by the
    difference of the distances from it and from the third, which runs straight where
    level sets run aslant.
    """
    loops = nodes.select(F.col("node").alias("row"), F.col("node").alias("col"))
    comps = cut(components(edges.select("row", "col").union(loops)).select("node", F.col("comp").alias("part")))
    first = sweep(edges, comps.groupBy("part").agg(F.min("node").alias("node"))).withColumnRenamed("level", "d0")
    second = _swept(edges, first, F.col("d0")).withColumnRenamed("level", "d1")
    both = cut(first.join(second.select("node", "d1"), "node"))
    third = _swept(edges, both, F.least("d0", "d1")).withColumnRenamed("level", "d2")
    along = cut(both.join(third.select("node", "d2"), "node").withColumnRenamed("part", "comp").join(nodes, "node"))
    shares = [_shared(along, key, parts, total) for key in (F.col("d1"), F.col("d1") - F.col("d2"))]
    return min(shares, key=lambda found: cut_weight(edges, found))


def _swept(edges: DataFrame, known: DataFrame, far: Column) -> DataFrame:
    """Distances from the least of the nodes of each part with the greatest `far`."""
    return sweep(edges, known.groupBy("part").agg(F.max_by("node", F.struct(far, -F.col("node"))).alias("node")))


def _shared(along: DataFrame, key: Column, parts: int, total: int) -> DataFrame:
    placed = prefix_sum(along.withColumn("_key", key), ["comp", "_key", "node"], F.col("w"), "before")
    part = F.least(F.floor((F.col("before") + F.col("w") / 2) * parts / total), F.lit(parts - 1))
    return cut(placed.select("node", "w", part.cast("int").alias("part")))


def _first(moves: DataFrame, by: str, room: Column, ok: str) -> DataFrame:
    """`moves` with `ok`: whether the weights of a part's moves up to this one, the best first, fit its room."""
    summed = cut(prefix_sum(moves, [by, "loss", "node"], F.col("w"), "_upto"))
    base = summed.groupBy(by).agg(F.min("_upto").alias("_base"))
    return cut(summed.join(base, by).withColumn(ok, F.col("_upto") - F.col("_base") + F.col("w") <= room).drop("_upto", "_base"))


def cut_weight(edges: DataFrame, parts: DataFrame) -> int:
    """Weight of the edges (row, col, w), told both ways, between parts."""
    ends = edges.join(parts.select(F.col("node").alias("row"), F.col("part").alias("p")), "row").join(parts.select(F.col("node").alias("col"), F.col("part").alias("q")), "col")
    return (ends.filter("p <> q").agg(F.sum("w")).first()[0] or 0) // 2


def _refined(nodes: DataFrame, edges: DataFrame, parts: int, total: int) -> DataFrame:
    """`nodes` (node, w, part) after moves that lessen the cut, kept while they do.

    In turn only moves to higher and to lower parts are made, so that neighbours do
    not change places. Of the moves of a part the best go, as far as neither it grows
    over SLACK nor the parts that they leave shrink under it.
    """
    mean, before, idle = total / parts, cut_weight(edges, nodes), 0
    for turn in range(2 * MOVES):
        beside = edges.join(nodes.select(F.col("node").alias("col"), F.col("part").alias("to")), "col").groupBy(F.col("row").alias("node"), "to").agg(F.sum("w").alias("s"))
        beside = cut(beside.join(nodes, "node"))
        inside = beside.filter("to = part").select("node", F.col("s").alias("own"))
        way = F.col("to") > F.col("part") if turn % 2 == 0 else F.col("to") < F.col("part")
        best = beside.filter(way).groupBy("node", "w", "part").agg(F.max_by(F.struct("to", "s"), F.struct("s", -F.col("to"))).alias("b"))
        moves = best.join(inside, "node", "left").select("node", "w", "part", "b.to", (F.coalesce("own", F.lit(0)) - F.col("b.s")).alias("loss"))
        sizes = cut(nodes.groupBy("part").agg(F.sum("w").alias("size")))  # a row for each part
        moves = moves.filter("loss < 0").join(sizes, "part").withColumnRenamed("size", "from_size")
        moves = cut(moves.join(sizes.select(F.col("part").alias("to"), F.col("size").alias("to_size")), "to"))
        if moves.isEmpty():
            after = before
        else:
            fit = _first(moves, "to", mean * (1 + SLACK) - F.col("to_size"), "enters")
            fit = _first(fit, "part", F.col("from_size") - mean * (1 - SLACK), "leaves").filter("enters and leaves")
            moved = cut(nodes.join(fit.select("node", "to"), "node", "left").select("node", "w", F.coalesce("to", "part").alias("part")))
            after = cut_weight(edges, moved)
        idle = 0 if after < before else idle + 1
        if after < before:
            nodes, before = moved, after
        if idle == 2:
            break
    return nodes


def partition(pat: DataFrame, parts: int) -> DataFrame:
    """(node, part): the nodes of a pattern (row, col) in parts 0 to parts - 1 of nearly equal size with few edges between them.

    Heavy-edge matching halves the graph until it is small or shrinks no more; the
    coarsest is shared out along its level sets; on the way back each level is
    refined by moves of nodes between parts. All steps are joins, aggregates and
    prefix sums, so a graph that does not shrink, as a star, needs no driver either. A
    coarse node weighs a fortieth of a part at most (or is one node), which bounds what
    the shares differ by.
    """
    edges = cut(both_ways(pat).withColumn("w", F.lit(1).cast("long")))
    nodes = cut(pat.select(F.col("row").alias("node")).union(pat.select("col")).distinct().withColumn("w", F.lit(1).cast("long")))
    n = total = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0).alias("part"))
    ladder = []
    while n > COARSE_NODES * parts:
        to = _matched(nodes, edges, max(2, total / parts / 40))
        coarse = cut(nodes.join(to, "node").groupBy(F.col("to").alias("node")).agg(F.sum("w").alias("w")))
        ends = edges.join(to.select(F.col("node").alias("row"), F.col("to").alias("r")), "row").join(to.select(F.col("node").alias("col"), F.col("to").alias("c")), "col")
        fewer = coarse.count()
        if fewer > 0.95 * n:
            break
        ladder.append((nodes, edges, to))
        nodes, n = coarse, fewer
        edges = cut(ends.filter("r <> c").groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.sum("w").alias("w")))
    found = _refined(_spread(nodes, edges, parts, total), edges, parts, total)
    for nodes, edges, to in reversed(ladder):
        below = nodes.join(to, "node").join(found.select(F.col("node").alias("to"), "part"), "to").select("node", "w", "part")
        found = _refined(cut(below), edges, parts, total)
    return found.select("node", "part")


def ghosts(pat: DataFrame, parts: DataFrame, layers: int = 1) -> DataFrame:
    """(part, node, owner, layer): nodes of other parts within so many edges of a part, with the one part that owns each.

    To `part` this is what it receives, to `owner` what it sends.
    """
    edges = cut(both_ways(pat))
    seen = [cut(parts.select("part", "node"))]
    out = []
    for layer in range(1, layers + 1):
        near = seen[-1].join(edges, F.col("node") == F.col("row")).select("part", F.col("col").alias("node")).distinct()
        near = cut(near.join(reduce(DataFrame.union, seen), ["part", "node"], "left_anti"))
        seen.append(near)
        out.append(near.withColumn("layer", F.lit(layer)))
    owners = parts.select("node", F.col("part").alias("owner"))
    return reduce(DataFrame.union, out).join(owners, "node").select("part", "node", "owner", "layer")


def exchanged(values: DataFrame, parts: DataFrame, table: DataFrame) -> DataFrame:
    """(part, node, val): each part's own values (node, val) and those it receives by `ghosts`."""
    held = parts.select("part", "node").unionByName(table.select("part", "node"))
    return held.join(values, "node").select("part", "node", "val")
