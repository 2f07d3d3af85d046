"""Orderings of the nodes of a graph given as a pattern (row, col).

Nodes that are all joined with each other may be given as `groups` (elem, node)
beside the pattern instead of as pairs, whose number is the square of the group's: a walk
enters a group once, and the results are those of the pattern with all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.prefix import dense_index, prefix_sum
from tessera.operators import sparsity
from tessera.session import cut


def with_pairs(pat: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(row, col): the pattern with the groups as pairs, the diagonal among them."""
    return pat.select("row", "col") if groups is None else sparsity.union_pattern(pat, sparsity.pattern(groups))


def _least_parents(front: DataFrame, edges: DataFrame, groups: DataFrame | None, entered: DataFrame | None, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """((node, by...) next to the front, the least of `by` for each node; groups entered so far). A group entered before has no new nodes."""
    least = lambda rows, key: rows.groupBy(key).agg(F.min(F.struct(*by)).alias("_b"))
    near = least(front.join(edges, F.col("node") == F.col("row")).select(F.col("col").alias("_to"), *by), "_to")
    if groups is not None:
        met = least(front.join(groups.withColumnRenamed("node", "_g"), F.col("node") == F.col("_g")).select("elem", *by), "elem")
        met = cut(met if entered is None else met.join(entered, "elem", "left_anti"))
        entered = met.select("elem") if entered is None else cut(entered.union(met.select("elem")))
        near = near.unionByName(groups.join(met, "elem").select(F.col("node").alias("_to"), "_b")).groupBy("_to").agg(F.min("_b").alias("_b"))
    return near.select(F.col("_to").alias("node"), "_b.*"), entered


def levels(pat: DataFrame, root: int, groups: DataFrame | None = None) -> DataFrame:
    """(node, level): breadth-first distance from the root; nodes out of reach are left out."""
    edges = cut(pat.filter("row <> col").select("row", "col"))
    groups = None if groups is None else cut(groups.select("elem", "node").distinct())
    nodes = pat.select(F.col("row").alias("node"))
    nodes = nodes if groups is None else nodes.union(groups.select("node"))
    seen = cut(nodes.filter(F.col("node") == root).distinct().withColumn("level", F.lit(0)))
    front, level, entered = seen, 0, None
    while True:
        level += 1
        new, entered = _least_parents(front, edges, groups, entered, ["level"])
        front = cut(new.select("node").join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if not front.take(1):
            return seen
        seen = cut(seen.union(front))


def components(pat: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(node, comp): the least node that each node hangs together with.

    Every node takes the least label of its neighbours and then the label of its
    label, so that the rounds are about the logarithm of the longest path. A group is
    a node of its own with a number above all others.
    """
    if groups is not None:
        hubs, top = hubbed(groups, pat)
        found = components(pat.select("row", "col").union(hubs.select("node", "hub")))
        return found.filter(F.col("node") <= top)
    edges = cut(pat.filter("row <> col").select("row", "col").union(pat.filter("row <> col").select("col", "row")).distinct())
    own = cut(pat.select(F.col("row").alias("node")).union(pat.select("col")).distinct().withColumn("comp", F.col("node")))
    before = None
    while True:
        near = edges.join(own, F.col("row") == F.col("node")).select(F.col("col").alias("node"), "comp")
        # a label hears of lower labels that its members have met, too
        heard = near.join(own.select("node", F.col("comp").alias("_l")), "node").select(F.col("_l").alias("node"), "comp")
        least = own.unionByName(near).unionByName(heard).groupBy("node").agg(F.min("comp").alias("comp"))
        least = cut(least)
        up = least.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        own = cut(least.join(up, F.col("comp") == F.col("_n"), "left").select("node", F.least("comp", F.coalesce("_c", "comp")).alias("comp")))
        now = own.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return own
        before = now


def hubbed(groups: DataFrame, pat: DataFrame) -> tuple[DataFrame, int]:
    """((node, elem, hub), top): the groups with a number above all nodes for each, and the greatest node."""
    top = pat.select("row").union(pat.select("col")).union(groups.select("node")).agg(F.max("row")).first()[0] or 0
    members = cut(groups.select("elem", "node").distinct())
    return cut(dense_index(members, "elem", "_h").select("node", "elem", (F.col("_h") + (top + 1)).cast("long").alias("hub"))), top


def rcm(pat: DataFrame, root: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """(old, new): reverse Cuthill-McKee by level sets from a root.

    The neighbours of a level follow in the order of (their first parent, their id);
    when nothing is left to reach, the least unvisited node starts anew. At the end
    the order is reversed. All components advance together, each in its own range of
    places (the root's first, then by their least node), so the rounds are the levels
    of the deepest one. Each round is a join with the frontier.
    """
    edges = cut(pat.filter("row <> col").select("row", "col").distinct())
    groups = None if groups is None else cut(groups.select("elem", "node").distinct())
    comps = components(pat, groups)
    n = comps.count()
    first = F.max(F.col("node") == root)
    starts = comps.groupBy("comp").agg(F.count("*").alias("n"), first.alias("has"))
    starts = cut(starts.withColumn("rank", F.when(F.col("has"), F.lit(-1).cast("long")).otherwise(F.col("comp"))))
    starts = cut(prefix_sum(starts, "rank", F.col("n"), "place").select("comp", "place", F.when(F.col("has"), F.lit(root)).otherwise(F.col("comp")).alias("node")))
    seen = cut(starts.select("node", "comp", F.col("place").cast("long").alias("visit")))
    done = cut(starts.select("comp", (F.col("place") + 1).alias("next")))
    front, entered = seen, None
    while True:
        new, entered = _least_parents(front, edges, groups, entered, ["visit", "comp"])
        new = cut(new.select("node", "comp", F.col("visit").alias("parent")).join(seen.select("node"), "node", "left_anti"))
        if not new.take(1):
            break
        # place: rank of (parent, node) inside the component; parents are in the order of components, so one sum serves all
        by_parent = cut(new.groupBy("parent", "comp").agg(F.count("*").alias("n")))
        sums = cut(prefix_sum(by_parent, "parent", F.col("n"), "start"))
        base = sums.groupBy(F.col("comp").alias("_c")).agg(F.min("start").alias("base"), F.sum("n").alias("size"))
        inside = F.row_number().over(Window.partitionBy("parent").orderBy("node")) - 1
        placed = new.withColumn("_in", inside).join(sums.select("parent", "start"), "parent").join(base, F.col("comp") == F.col("_c"))
        placed = placed.join(done, "comp")
        front = cut(placed.select("node", "comp", (F.col("next") + F.col("start") - F.col("base") + F.col("_in")).cast("long").alias("visit")))
        done = cut(done.join(base, F.col("comp") == F.col("_c"), "left").select("comp", (F.col("next") + F.coalesce("size", F.lit(0))).alias("next")))
        seen = cut(seen.union(front))
    return seen.select(F.col("node").alias("old"), (n - 1 - F.col("visit")).alias("new"))


def rcm_repeated(pat: DataFrame, rounds: int, groups: DataFrame | None = None) -> DataFrame:
    """RCM again and again, each time from the node that the last order gave to node 0."""
    root, perm = 0, None
    for _ in range(rounds):
        perm = cut(rcm(pat, root, groups))
        root = perm.filter("old = 0").first()["new"]
    return perm


def inverse(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("new").alias("old"), F.col("old").alias("new"))


def identity(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node").alias("old"), F.col("node").alias("new"))


def permuted_bandwidth(pat: DataFrame, perm: DataFrame, groups: DataFrame | None = None) -> int:
    """The bandwidth of the pattern after `perm`; of a group the first and last place matter."""
    moved = sparsity.apply_perm(pat.select("row", "col"), perm)
    if groups is not None:
        placed = groups.join(perm.select(F.col("old").alias("node"), "new"), "node")
        moved = moved.union(placed.groupBy("elem").agg(F.min("new").alias("row"), F.max("new").alias("col")).select("row", "col"))
    return sparsity.bandwidth(moved).first()[0]


def q_order(pat: DataFrame, perm: DataFrame, p: float, seed: int = 0, groups: DataFrame | None = None) -> DataFrame:
    """(old, new): `perm` shuffled inside chunks of width trunc(bandwidth / p), by a seed. A shuffle is one sort over all rows, by chunk and hash."""
    width = max(1, int(permuted_bandwidth(pat, perm, groups) / p))
    chunk, mixed = F.floor(F.col("new") / width), F.xxhash64(F.lit(seed), F.col("old"))
    rows = cut(perm.select("old", chunk.alias("chunk"), mixed.alias("mixed")))
    placed = cut(prefix_sum(rows, ["chunk", "mixed", "old"], F.lit(1).cast("long"), "at"))
    first = placed.groupBy("chunk").agg(F.min("at").alias("first"))
    return placed.join(first, "chunk").select("old", (F.col("chunk") * width + F.col("at") - F.col("first")).cast("long").alias("new"))
