"""Nested dissection: an order of a graph's nodes in which vertex separators follow all that they separate."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.prefix import prefix_sum
from tessera.operators.ordering import components
from tessera.session import cut

#: Parts of no more nodes are not cut again.
LEAF = 64
#: Edges that one task walks along, about.
BLOCK_EDGES = 400_000
#: Parts of no more edges, told both ways, are cut to the end by one task each.
TASK_EDGES = 200_000


def both_ways(pat: DataFrame) -> DataFrame:
    """(row, col) of a pattern's edges between different nodes, each in both directions once."""
    off = pat.filter("row <> col").select("row", "col")
    return off.union(off.select("col", "row")).distinct()


def _walked(links: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Levels of a block's nodes after the `fresh` rows among (node, part, level), and those that they give to nodes of other blocks (not `own`)."""
    ids = np.unique(np.concatenate((links["row"], rows["node"])))
    level, part = np.full(len(ids), np.iinfo("int32").max, dtype="int64"), np.zeros(len(ids), dtype="int64")
    at = np.searchsorted(ids, rows["node"])
    np.minimum.at(level, at, rows["level"].to_numpy("int64"))
    part[at] = rows["part"]
    links = links.sort_values("row", kind="stable")
    here = (links["to_block"] == links["block"]).to_numpy()
    inner = links[here]
    to = np.searchsorted(ids, inner["col"])
    first = np.searchsorted(inner["row"], ids)
    n = np.searchsorted(inner["row"], ids, side="right") - first
    seeds = at[rows["fresh"].to_numpy()]
    seeds = seeds[np.argsort(level[seeds], kind="stable")]
    heights, met, changed, front, now = level[seeds].copy(), 0, [], seeds[:0], 0
    while len(front) or met < len(seeds):
        now = now if len(front) else int(heights[met])
        upto = int(np.searchsorted(heights, now, side="right"))
        front = np.unique(np.concatenate((front, seeds[met:upto][level[seeds[met:upto]] == now])))
        met = upto
        changed.append(front)
        counts = n[front]
        near = to[np.repeat(first[front] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        near, parts = near[level[near] > now + 1], np.repeat(part[front], counts)[level[near] > now + 1]
        level[near], part[near] = now + 1, parts
        front, now = np.unique(near), now + 1
    known = np.flatnonzero(level < np.iinfo("int32").max)
    block = int(rows["block"].iloc[0])
    own = pd.DataFrame({"block": block, "node": ids[known], "part": part[known], "level": level[known], "own": True})
    moved = np.zeros(len(ids), dtype=bool)
    moved[np.concatenate(changed)] = True
    outer = links[~here]
    end = np.searchsorted(ids, outer["row"])
    sent = pd.DataFrame({"block": outer["to_block"], "node": outer["col"], "part": part[end], "level": level[end] + 1, "own": False})[moved[end]]
    return pd.concat((own, sent))


def sweep(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(part, node, level): distances from the starts (part, node) within their parts, all parts at once.

    `edges` go both ways and join only nodes of one part. Ranges of nodes with about
    BLOCK_EDGES edges are walked inside a task as far as they reach, and tell other ranges what
    they give to them until nothing gets nearer: the rounds are the borders of ranges on a
    shortest path and not its edges.
    """
    blocks = edges.count() // BLOCK_EDGES + 1
    links = edges.select("row", "col")
    links = links.repartitionByRange(blocks, "row").withColumn("block", F.spark_partition_id().cast("long")) if blocks > 1 else links.withColumn("block", F.lit(0).cast("long"))
    links = cut(links)
    place = cut(links.select("row", "block").distinct())
    if blocks > 1:
        links = cut(links.join(place.select(F.col("row").alias("col"), F.col("block").alias("to_block")), "col").select("row", "col", "block", "to_block"))
    else:
        links = links.withColumn("to_block", F.col("block"))
    fresh = starts.select("part", F.col("node").alias("row")).join(place, "row", "left")
    fresh = cut(fresh.select(F.coalesce("block", F.lit(0)).cast("long").alias("block"), F.col("row").alias("node"), F.col("part").cast("long").alias("part"), F.lit(0).cast("long").alias("level")))
    known = None
    while True:
        active = fresh.select("block").distinct()
        rows = fresh.withColumn("fresh", F.lit(True))
        if known is not None:
            rows = rows.unionByName(known.join(active, "block", "left_semi").withColumn("fresh", F.lit(False)))
        made = rows.groupBy("block").cogroup(links.join(active, "block", "left_semi").groupBy("block")).applyInPandas(lambda r, e: _walked(e, r), "block long, node long, part long, level long, own boolean")
        made = cut(made)
        own, told = made.filter("own").drop("own"), made.filter("not own").groupBy("block", "node").agg(F.min("part").alias("part"), F.min("level").alias("level"))
        known = own if known is None else cut(own.unionByName(known.join(active, "block", "left_anti")))
        if blocks > 1:
            told = told.join(known.select("node", F.col("level").alias("_had")), "node", "left").filter("_had is null or level < _had").select("block", "node", "part", "level")
            fresh = cut(told)
        if blocks == 1 or fresh.isEmpty():
            return known.select("part", "node", F.col("level").cast("int").alias("level"))


def separated(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, node, level, separates, splits): the separator of each connected part (part, node) by its level sets.

    The levels go out from the least of the nodes farthest from the part's least node.
    Of the levels with nodes on both sides the one with the least ratio of its size to
    the smaller side is taken, ties to the lowest; its nodes without a neighbour in the
    next level stay with the lower side. Parts of two levels have none and do not split.
    """
    far = sweep(edges, parts.groupBy("part").agg(F.min("node").alias("node")))
    starts = far.groupBy("part").agg(F.max_by("node", F.struct("level", -F.col("node"))).alias("node"))
    reached = sweep(edges, starts)
    along = Window.partitionBy("part").orderBy("level")
    sizes = reached.groupBy("part", "level").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("below", F.sum("n").over(along) - F.col("n")).withColumn("above", F.sum("n").over(Window.partitionBy("part")) - F.col("below") - F.col("n"))
    ratio = F.col("n") / F.least("below", "above")
    best = sizes.filter("below > 0 and above > 0").groupBy("part").agg(F.min_by("level", F.struct(ratio, F.col("level"))).alias("cut_at"))
    marked = reached.join(best, "part", "left")
    edge_in = marked.filter("level = cut_at").join(edges, F.col("node") == F.col("row")).select("node", "col")
    beyond = marked.filter("level = cut_at + 1").select(F.col("node").alias("col"))
    needed = edge_in.join(beyond, "col", "left_semi").select("node").distinct().withColumn("separates", F.lit(True))
    return cut(marked.join(needed, "node", "left").select("part", "node", "level", F.coalesce("separates", F.lit(False)).alias("separates"), F.col("cut_at").isNotNull().alias("splits")))


def _reached(near: dict[int, list[int]], inside: set[int], start: int) -> dict[int, int]:
    """Distances from the start inside a set of nodes."""
    level, queue = {start: 0}, [start]
    for x in queue:
        for y in near[x]:
            if y in inside and y not in level:
                level[y] = level[x] + 1
                queue.append(y)
    return level


def _taken_apart(pdf: pd.DataFrame, leaf: int, depths: int | None) -> pd.DataFrame:
    """The rounds of `tree` over one connected part, given by its edges; `below` holds the parts under it that a node lay in."""
    near: dict[int, list[int]] = {}
    for a, b in zip(pdf["row"].tolist(), pdf["col"].tolist(), strict=True):
        near.setdefault(a, []).append(b)
    out, todo = [], [(set(near), [])]
    while todo:
        inside, below = todo.pop()
        best = None
        if len(inside) > leaf and (depths is None or len(below) < depths):
            far = _reached(near, inside, min(inside))
            level = _reached(near, inside, min(far, key=lambda x: (-far[x], x)))
            sizes = np.bincount(list(level.values()))
            under = np.cumsum(sizes) - sizes
            least = np.minimum(under, len(inside) - under - sizes)
            best = min((k for k in range(len(sizes)) if least[k] > 0), key=lambda k: (sizes[k] / least[k], k), default=None)
        if best is None:
            out.extend((x, below, False) for x in inside)
            continue
        first = {x for x, k in level.items() if k == best and any(level.get(y) == best + 1 for y in near[x])}
        out.extend((x, below, True) for x in first)
        left = inside - first
        for x in sorted(left):
            if x in left:
                part = set(_reached(near, left, x))
                left -= part
                todo.append((part, [*below, x]))
    return pd.DataFrame({"node": [r[0] for r in out], "below": [r[1] for r in out], "separates": [r[2] for r in out]})


def tree(pat: DataFrame, leaf: int = LEAF, depths: int | None = None) -> DataFrame:
    """(node, path, separates): where the nodes of a pattern (row, col) stand in the tree of parts.

    `path` holds the parts that the node lay in, the whole component first; a part is
    named by its least node. A node that separates belongs to the separator of its
    last part, the others to a part that is not cut: of at most `leaf` nodes, of two
    levels only, or as deep as `depths`. No edge joins nodes of which neither's path
    is the beginning of the other's. All parts of a depth are cut together, and a part of at most
    TASK_EDGES edges goes to one task with all that lies under it, so the rounds are those of the larger parts only.
    """
    edges = cut(both_ways(pat))
    left = cut(pat.select(F.col("row").alias("node")).union(pat.select("col")).distinct().withColumn("path", F.array().cast("array<long>")))
    done, depth = [], 0
    while True:
        comps = components(edges.union(left.select(F.col("node").alias("row"), F.col("node").alias("col"))))
        left = left.join(comps, "node").select("node", F.concat("path", F.array(F.col("comp").cast("long"))).alias("path"), F.col("comp").alias("part"))
        sizes = left.groupBy("part").agg((F.count("*") > (leaf if depths is None or depth < depths else 2**62)).alias("large"))
        left = cut(left.join(sizes, "part"))
        done.append(left.filter("not large").select("node", "path", F.lit(False).alias("separates")))
        left = left.filter("large").drop("large")
        within = edges.join(left.select(F.col("node").alias("row"), "part"), "row")
        few = cut(within.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") <= TASK_EDGES).select("part"))
        more = None if depths is None else depths - depth
        under = within.join(few, "part", "left_semi").groupBy("part").applyInPandas(lambda pdf: _taken_apart(pdf, leaf, more), "node long, below array<long>, separates boolean")
        done.append(cut(under.join(left.select("node", "path"), "node").select("node", F.concat("path", "below").alias("path"), "separates")))
        left = cut(left.join(few, "part", "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.union, done)
        inner = edges.join(left.select(F.col("node").alias("row")), "row", "left_semi")
        marked = separated(inner, left).select("node", "separates", "splits")
        left = cut(left.join(marked, "node"))
        done.append(left.filter("separates or not splits").select("node", "path", "separates"))
        left = cut(left.filter("splits and not separates").select("node", "path"))
        keep = left.select(F.col("node").alias("row"))
        edges = cut(edges.join(keep, "row", "left_semi").join(keep.withColumnRenamed("row", "col"), "col", "left_semi").select("row", "col"))
        depth += 1


def _least_degree_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """The place of each node of one part (at most a leaf's nodes): minimum degree inside, neighbours outside only counted, ties by id."""
    near = {n: set(i) for n, i in zip(pdf["node"], pdf["inside"], strict=True)}
    outside = dict(zip(pdf["node"], pdf["outside"], strict=True))
    places = []
    while near:
        node = min(near, key=lambda n: (len(near[n]) + outside[n], n))
        places.append(node)
        others = near.pop(node)
        for n in others:
            near[n] = (near[n] | others) - {n, node}
            outside[n] = max(outside[n], outside[node])
    return pd.DataFrame({"node": pd.Series(places, dtype="int64"), "place": range(len(places))})


def nested_dissection(pat: DataFrame, leaf: int = LEAF, stands: DataFrame | None = None) -> DataFrame:
    """(old, new): the deepest parts first, each separator after all that it separates.

    Parts of one depth do not touch, so that depth by depth fills as much as part by
    part. Parts of at most `leaf` nodes are ordered by minimum degree, a group each;
    separators, and larger parts that have none, by degree; ties by id. `stands` is `tree(pat, leaf)`, where it is known already.
    """
    edges = cut(both_ways(pat))
    placed = cut((tree(pat, leaf) if stands is None else stands).select("node", (-F.size("path")).alias("deep"), F.element_at("path", -1).alias("part"), "separates"))
    small = placed.groupBy("deep", "part").agg(F.min(~F.col("separates")).alias("whole"), F.count("*").alias("n")).filter((F.col("n") <= leaf) & F.col("whole"))
    own = placed.join(small.select("deep", "part"), ["deep", "part"], "left_semi").select("node", "part")
    other = own.select(F.col("node").alias("col"), F.col("part").alias("to"))
    near = own.join(edges, F.col("node") == F.col("row"), "left").join(other, "col", "left")
    inside = F.col("to") == F.col("part")
    near = near.groupBy("part", "node").agg(F.collect_list(F.when(inside, F.col("col"))).alias("inside"), F.count(F.when(~F.coalesce(inside, F.lit(False)), F.col("col"))).alias("outside"))
    places = near.groupBy("part").applyInPandas(_least_degree_first, "node long, place long")
    degree = edges.groupBy(F.col("row").alias("node")).agg(F.count("*").alias("place"))
    rest = placed.join(small.select("deep", "part"), ["deep", "part"], "left_anti").select("node").join(degree, "node", "left").fillna(0, ["place"])
    keyed = cut(placed.join(places.unionByName(rest), "node").select("deep", "part", "place", "node"))
    return prefix_sum(keyed, ["deep", "part", "place", "node"], F.lit(1).cast("long"), "new").select(F.col("node").alias("old"), F.col("new").cast("long").alias("new"))
