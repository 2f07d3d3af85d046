"""Full fill of a symmetric pattern by its elimination forest: nothing of the fill's size is joined, sorted or shuffled.

The parent of a node is its least higher neighbour after elimination. Row i fills in along
the paths of the forest from i's lower neighbours up to i. The forest is laid out in
chains, a node's heaviest child going on with its chain, so that a path is an interval on
each of a few chains, and of all paths of a row the longest interval on a chain counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sparsity import dealt
from tessera.session import cut

#: Edges that one task takes at a time, about.
BLOCK_EDGES = 500_000
#: Chain positions of which the nodes stand in one row.
BLOCK_NODES = 1024
#: Rows that meet one copy of a block, and pairs made in a task, both about.
BLOCK_ROWS = 4096
TASK_PAIRS = 10_000_000


def lower_links(pat: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(lo, hi): each off-diagonal pair once; a group (elem, node) gives its members their least one only, as its members lie on one path of the forest."""
    links = pat.filter("row <> col").select(F.least("row", "col").alias("lo"), F.greatest("row", "col").alias("hi"))
    if groups is not None:
        least = groups.groupBy("elem").agg(F.min("node").alias("lo"))
        links = links.union(groups.join(least, "elem").filter("lo < node").select("lo", F.col("node").alias("hi")))
    return links.distinct()


def _eliminated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (lo, hi, size null) and counts (lo, hi null, size) of a range of lo -> (lo, parent, size) of its nodes and, with `later`, links and counts above it.

    A node hands its other higher neighbours to the least one. Lists are merged small into large.
    """
    rows = pd.concat(list(batches))
    if not len(rows):
        return
    last = int(rows["lo"].max())
    links = rows[rows["hi"].notna()]
    above = {int(k): v.astype("int64").tolist() for k, v in links.groupby("lo")["hi"]}
    sizes = rows[rows["size"].notna()].groupby("lo")["size"].sum().astype("int64").to_dict()
    for heap in above.values():
        heapify(heap)
    todo = sorted({*above, *sizes})
    heapify(todo)
    out: list[tuple] = []
    before = None
    while todo:
        j = heappop(todo)
        if j == before:
            continue
        before = j
        heap, size = above.pop(j, []), sizes.pop(j, 0) + 1
        parent = heappop(heap) if heap else None
        while heap and heap[0] == parent:
            heappop(heap)
        out.append((j, parent, size, False))
        if parent is None:
            continue
        if parent > last:
            out.append((parent, None, size, True))
            ends = sorted({parent, *heap})
            out.extend((a, b, None, True) for a, b in zip(ends, ends[1:], strict=False))
            continue
        sizes[parent] = sizes.get(parent, 0) + size
        other = above.get(parent, [])
        if len(other) < len(heap):
            heap, other = other, heap
        for i in heap:
            heappush(other, i)
        above[parent] = other
        heappush(todo, parent)
    yield pd.DataFrame({"lo": [r[0] for r in out], "hi": pd.array([r[1] for r in out], dtype="Int64"), "size": pd.array([r[2] for r in out], dtype="Int64"), "later": [r[3] for r in out]})


def forest(links: DataFrame) -> DataFrame:
    """(node, parent, size) of the elimination forest of (lo, hi); size counts the node and all below it. Nodes without a link are left out.

    A node with several higher neighbours is first tied to the least of them only, and
    they to each other in a row, which hangs the same nodes together below any number and
    leaves a clique as many links as members. Ranges of nodes follow each other; one
    takes about BLOCK_EDGES links.
    """
    prior = F.lag("hi").over(Window.partitionBy("lo").orderBy("hi"))
    links = cut(links.select(F.coalesce(prior, "lo").alias("lo"), "hi").distinct())
    n = links.count()
    blocks = n // BLOCK_EDGES + 1
    # a node that is nobody's lower end is a root in the end: it stands in the last range at the latest
    ends = links.select("lo", "hi", F.lit(None).cast("long").alias("size")).union(links.select(F.col("hi"), F.lit(None).cast("long"), F.lit(0).cast("long")).distinct())
    bounds = sorted({float(b) for b in links.approxQuantile("lo", [k / blocks for k in range(1, blocks)], 0.001)}) if blocks > 1 else []
    left, done = ends, []
    for bound in [*bounds, None]:
        now = left if bound is None else left.filter(F.col("lo") <= bound)
        made = cut(now.coalesce(1).mapInPandas(_eliminated, "lo long, hi long, size long, later boolean"))
        done.append(made.filter("not later").select(F.col("lo").alias("node"), F.col("hi").alias("parent"), "size"))
        if bound is not None:
            left = left.filter(F.col("lo") > bound).union(made.filter("later").select("lo", "hi", "size"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _climbed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, up) of a range of nodes, up the parent or the node itself -> (node, chain, pos): the last node on the way up that the range knows of, and the steps there."""
    rows = pd.concat(list(batches))
    if not len(rows):
        return
    rows = rows.sort_values("node", ascending=False)
    found: dict[int, tuple[int, int]] = {}
    for node, up in zip(rows["node"].tolist(), rows["up"].tolist(), strict=True):
        chain, pos = found.get(up, (up, 0))
        found[node] = (chain, pos + (up != node))
    yield pd.DataFrame([(node, *at) for node, at in found.items()], columns=["node", "chain", "pos"])


def chains(tree: DataFrame) -> DataFrame:
    """(node, chain, pos, up): the chain of each node, named by its top, the steps to the top, and the top's parent.

    A parent is above its node, so a range of about BLOCK_EDGES nodes goes up by itself. Between
    ranges steps double, so the rounds are the logarithm of the ranges.
    """
    heavy = tree.filter("parent is not null").groupBy("parent").agg(F.max_by("node", F.struct("size", -F.col("node"))).alias("node"))
    ways = cut(tree.join(heavy.select("node", F.lit(True).alias("on")), "node", "left").select("node", F.when(F.col("on"), F.col("parent")).otherwise(F.col("node")).alias("up")))
    ranges = ways.count() // BLOCK_EDGES + 1
    dealt_out = ways.repartitionByRange(ranges, "node") if ranges > 1 else ways.repartition(1)
    at = cut(dealt_out.mapInPandas(_climbed, "node long, chain long, pos long"))
    moved = None
    while ranges > 1:
        ahead = at.select(F.col("node").alias("chain"), F.col("chain").alias("_c"), F.col("pos").alias("_p"))
        at = cut(at.join(ahead, "chain").select("node", F.col("_c").alias("chain"), (F.col("pos") + F.col("_p")).alias("pos")))
        now = at.agg(F.sum("pos")).first()[0]
        if now == moved:
            break
        moved = now
    return cut(at.join(tree.select(F.col("node").alias("chain"), F.col("parent").alias("up")), "chain").select("node", "chain", "pos", "up"))


def intervals(pat: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((row, chain, upper, lower), chains): the lower triangle's fill of each row as the chain positions from upper to lower, each chain once a row."""
    links = cut(lower_links(pat, groups))
    at = chains(cut(forest(links)))
    own = at.select(F.col("node").alias("hi"), F.col("chain").alias("_c"), F.col("pos").alias("_p"))
    steps, done = cut(links.join(own, "hi")), []
    while True:
        entered = steps.join(at.select(F.col("node").alias("lo"), "chain", "pos", "up"), "lo")
        on = F.col("chain") == F.col("_c")
        best = cut(entered.groupBy("hi", "_c", "_p", "chain", "up").agg(F.max("pos").alias("lower")))
        done.append(best.select(F.col("hi").alias("row"), "chain", F.when(on, F.col("_p") + 1).otherwise(0).alias("upper"), "lower"))
        steps = cut(best.filter(~on).select(F.col("up").alias("lo"), "hi", "_c", "_p").filter("lo < hi").distinct())
        if steps.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return cut(out.groupBy("row", "chain").agg(F.min("upper").alias("upper"), F.max("lower").alias("lower"))), at


def count(pat: DataFrame, groups: DataFrame | None = None) -> int:
    """Entries of the full fill, the diagonal of all nodes among them."""
    found, _ = intervals(pat, groups)
    return _nodes(pat, groups).count() + 2 * (found.agg(F.sum(F.col("lower") - F.col("upper") + 1)).first()[0] or 0)


def entries(pat: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(row, col) of the full fill, the diagonal among them. Chains are listed by BLOCK_NODES; pairs are made inside the row, in the last step.

    Spark puts tasks together by their bytes before pairs are made, and a block meets the rows of nearly all
    nodes: rows are dealt by the pairs that they will make, to copies of the blocks.
    """
    found, at = intervals(pat, groups)
    block = F.floor(F.col("pos") / BLOCK_NODES)
    lists = at.groupBy("chain", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("ns")).select("chain", "block", F.col("ns.node").alias("ns"))
    spans = found.select("row", "chain", "upper", "lower", F.explode(F.sequence(F.floor(F.col("upper") / BLOCK_NODES), F.floor(F.col("lower") / BLOCK_NODES))).alias("block"))
    first = F.greatest(F.lit(0), F.col("upper") - F.col("block") * BLOCK_NODES)
    end = F.least(F.lit(BLOCK_NODES - 1), F.col("lower") - F.col("block") * BLOCK_NODES)
    nodes = cut(_nodes(pat, groups))
    copies = nodes.count() // BLOCK_ROWS + 1
    # both are small beside the fill
    parts = cut(spans.select("row", "chain", "block", F.pmod(F.xxhash64("row"), F.lit(copies)).alias("copy"), first.cast("int").alias("first"), (end - first + 1).cast("int").alias("n")))
    lists = lists.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    n = (parts.agg(F.sum("n")).first()[0] or 0) // TASK_PAIRS + 1
    n = n if n == 1 else max(n, pat.sparkSession.sparkContext.defaultParallelism)
    key = ["chain", "block", "copy"]
    met = dealt(parts, n, *key).join(dealt(lists, n, *key), key)
    lower = met.select("row", F.slice("ns", F.col("first") + 1, F.col("n")).alias("ns"), F.explode(F.array(F.lit(True), F.lit(False))).alias("low")).select("row", "low", F.explode("ns").alias("col"))
    both = lower.select(F.when(F.col("low"), F.col("row")).otherwise(F.col("col")).alias("row"), F.when(F.col("low"), F.col("col")).otherwise(F.col("row")).alias("col"))
    return both.union(nodes.select(F.col("node").alias("row"), F.col("node").alias("col")))


def _nodes(pat: DataFrame, groups: DataFrame | None) -> DataFrame:
    nodes = pat.select(F.col("row").alias("node")).union(pat.select("col"))
    return (nodes if groups is None else nodes.union(groups.select("node"))).distinct()
