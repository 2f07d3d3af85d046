"""Fill-reducing orders and the distributed direct solver that follows them.

`fronts` is minimum degree on a quotient graph: what is eliminated becomes an element,
the list of its neighbours, and no fill edge is ever made. Each round eliminates an
independent set of nodes of (nearly) least degree. An element that a new one takes in
is absorbed, and nodes whose whole neighbourhood is the new element go with it (a
supervariable). The elements with their absorptions are the assembly tree. A graph that
holds groups of nodes, all joined with each other, may give them by their members: they are
elements from the start, and no pairs are made of them. Rounds are Spark jobs as long as edges and
members are more than TASK_ROWS, and go on in one task from there.

`multifrontal` runs over that tree by levels: a front is a dense matrix of its pivots
and border; it gathers its own entries and the updates of its children,
and hands its Schur complement to its parent. The tree's fronts of a level are
independent, and no table or group holds more than one front's square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.prefix import prefix_sum
from tessera.operators.ordering import hubbed
from tessera.session import cut

#: Nodes of a degree up to SLACK[0] times the least one plus SLACK[1] may go in the same round.
SLACK = (1.5, 3)
#: If all that remain have this share of the others as neighbours, they are one last front: its square is then little more than its fill.
DENSE = 0.75
#: Edges, both ways, and members of elements that one task takes to the end.
TASK_ROWS = 500_000


@dataclass
class Tree:
    """The assembly tree. pivots: (front, node, round, head); border: (front, node); levels: (front, level); parents: (front, parent)."""

    pivots: DataFrame
    border: DataFrame
    levels: DataFrame
    parents: DataFrame
    height: int


def _priority(node: str):
    """Neighbours of equal degree go by this, so that long chains break at many places in one round."""
    return F.xxhash64(node)


def fronts(pat: DataFrame, slack: tuple[float, int] = SLACK, groups: DataFrame | None = None) -> Tree:
    """The assembly tree of a pattern (row, col); it is taken as symmetric, and its diagonal and repeats do not matter.

    Degrees are upper bounds: a node's edges, plus the members of its elements. In a
    round a node goes if (degree, hash, id) is least among its candidate neighbours. What
    remains in the end, each of it next to nearly all the rest, is one front (DENSE).

    groups: (elem, node). A group would lose one node a round, as its nodes are all
    neighbours. So candidates whose elements are all the head's go into its front, too, if they
    come before the candidates on their own edges: the degree of the last of them is
    higher by the edges of the others. Such a front's border is that of all its pivots.
    """
    both = pat.filter("row <> col").select(F.col("row").alias("v"), F.col("col").alias("w"))
    edges = cut(both.unionByName(both.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    nodes, top = pat.select(F.col("row").alias("v")).union(pat.select("col")), None
    members = pat.sparkSession.createDataFrame([], "e long, v long, level int")
    if groups is not None:
        hubs, top = hubbed(groups, pat)
        members = cut(hubs.select(F.col("hub").alias("e"), F.col("node").alias("v"), F.lit(-1).alias("level")))
        edges = cut(edges.join(_inside(edges, members), ["v", "w"], "left_anti"))
        nodes = nodes.union(members.select("v"))
    nodes = nodes.distinct()
    zero, one = F.lit(0).cast("long").alias("d"), F.lit(1).cast("long").alias("d")
    pivots, border, levels, parents = [], [], [], []
    while True:
        if edges.count() + members.count() + (0 if pivots else nodes.count()) <= TASK_ROWS:
            rest = _rest(edges, members, None if pivots else nodes, len(pivots), slack, top)
            pivots.append(rest.filter("kind = 0").select("front", "node", "round", "head"))
            border.append(rest.filter("kind = 1").select("front", "node"))
            levels.append(rest.filter("kind = 2").select("front", "level"))
            parents.append(rest.filter("kind = 3").select("front", F.col("node").alias("parent")))
            break
        sizes = members.groupBy("e").agg((F.count("*") - 1).alias("d"))
        degrees = edges.select("v", one).unionByName(members.join(sizes, "e").select("v", "d"))
        degrees = cut((degrees if pivots else degrees.unionByName(nodes.select("v", zero))).groupBy("v").agg(F.sum("d").alias("d")))
        least, n, head = degrees.agg(F.min("d"), F.count("*"), F.min(F.struct("d", _priority("v").alias("p"), "v"))["v"]).first()
        if not n:
            break
        number = F.lit(len(pivots)).alias("round")
        if least >= DENSE * (n - 1):
            last = members.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("level"))
            pivots.append(degrees.select(F.lit(head).cast("long").alias("front"), F.col("v").alias("node"), number, (F.col("v") == head).alias("head")))
            levels.append(last.select(F.lit(head).cast("long").alias("front"), "level"))
            parents.append(_fronts_only(members, top).select(F.col("e").alias("front"), F.lit(head).cast("long").alias("parent")).distinct())
            break
        able = degrees.filter(F.col("d") <= int(slack[0] * least) + slack[1]).select("v", F.struct("d", _priority("v").alias("p"), "v").alias("key"))
        near = edges.join(able.select(F.col("v").alias("w"), "key"), "w").groupBy("v").agg(F.min("key").alias("least"))
        first = able.join(near, "v", "left").filter(F.col("least").isNull() | (F.col("key") <= F.col("least"))).select("v", "key")
        of_element = members.join(able, "v").groupBy("e").agg(F.min("key").alias("key"))
        around = members.join(of_element, "e").groupBy("v").agg(F.min("key").alias("least"))
        deep = members.groupBy("v").agg((F.max("level") + 1).alias("level"))
        chosen = first.join(around, "v", "left").filter(F.col("least").isNull() | (F.col("key") <= F.col("least"))).join(deep, "v", "left")
        chosen = cut(chosen.select(F.col("v").alias("head"), F.coalesce("level", F.lit(0)).alias("level")))
        absorbed = members.select("e", "v").join(chosen, F.col("v") == F.col("head")).select("e", "head")
        out = chosen.select("head", F.col("head").alias("v"))
        if groups is not None:
            own = members.groupBy("v").agg(F.count("*").alias("n"))
            shared = members.join(absorbed, "e").groupBy("head", "v").agg(F.count("*").alias("n"))
            out = cut(out.unionByName(shared.join(own, ["v", "n"]).join(first, "v", "left_semi").filter("v <> head").select("head", "v")))
        new = edges.join(out, "v").select("head", F.col("w").alias("v"))
        new = cut(new.unionByName(members.join(absorbed, "e").select("head", "v")).distinct().join(out, ["head", "v"], "left_anti"))
        # edges of what went, and those inside a new element, are told by elements from here on
        gone = out.select(F.col("v").alias("_g"))
        edges = edges.join(gone, F.col("v") == F.col("_g"), "left_anti").join(gone, F.col("w") == F.col("_g"), "left_anti")
        edges = cut(edges.join(_inside(edges, new.withColumnRenamed("head", "e")), ["v", "w"], "left_anti"))
        kept = members.join(absorbed.select("e"), "e", "left_anti").withColumn("new", F.lit(False))
        kept = kept.unionByName(new.join(chosen, "head").select(F.col("head").alias("e"), "v", "level", F.lit(True).alias("new")))
        # nodes in one element only, a new one, and with no edge besides go along with its head
        free = kept.groupBy("v").agg((F.count("*") == 1).alias("one"), F.first("new").alias("fresh")).join(edges.select("v"), "v", "left_anti").filter("one and fresh").select("v", F.lit(True).alias("along"))
        kept = cut(kept.join(free, "v", "left").select("e", "v", "level", F.coalesce("along", F.lit(False)).alias("along")))
        along = kept.filter("along").select(F.col("e").alias("front"), F.col("v").alias("node"), number, F.lit(False).alias("head"))
        pivots.append(out.select(F.col("head").alias("front"), F.col("v").alias("node"), number, (F.col("v") == F.col("head")).alias("head")).unionByName(along))
        border.append(kept.filter("not along").join(chosen, F.col("e") == F.col("head"), "left_semi").select(F.col("e").alias("front"), F.col("v").alias("node")))
        levels.append(chosen.select(F.col("head").alias("front"), "level"))
        parents.append(_fronts_only(absorbed, top).select(F.col("e").alias("front"), F.col("head").alias("parent")))
        members = cut(kept.filter("not along").drop("along"))
    whole = lambda parts, kind: cut(_union(parts)) if parts else pat.sparkSession.createDataFrame([], kind)
    deep = whole(levels, "front long, level int")
    height = deep.agg(F.max("level")).first()[0] or 0
    return Tree(whole(pivots, "front long, node long, round int, head boolean"), whole(border, "front long, node long"), deep, whole(parents, "front long, parent long"), height)


def _inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(v, w): the edges between two members (e, v) of an element."""
    return edges.join(members.select("e", "v"), "v").join(members.select("e", F.col("v").alias("w")), ["e", "w"], "left_semi").select("v", "w")


def _fronts_only(elements: DataFrame, top: int | None) -> DataFrame:
    """Rows whose element (e) is a front: groups have the numbers above the nodes and are none."""
    return elements if top is None else elements.filter(F.col("e") <= top)


def _rest(edges: DataFrame, members: DataFrame, nodes: DataFrame | None, number: int, slack: tuple[float, int], top: int | None) -> DataFrame:
    """Rounds from `number` on, of what is left, in one task: (kind, front, node, round, level, head) of pivots (0), border (1), levels (2) and parents (3)."""
    alive = edges.select("v").union(members.select("v"))
    alive = (alive if nodes is None else alive.union(nodes)).distinct()
    none, n = F.lit(None).cast("long"), F.lit(None).cast("int")
    rows = alive.select(F.lit(0).alias("kind"), F.col("v").alias("a"), _priority("v").alias("b"), n.alias("level"))
    rows = rows.union(edges.select(F.lit(1), "v", "w", n)).union(members.select(F.lit(2), "e", "v", "level"))
    made = rows.repartition(1).mapInPandas(partial(_eliminated, number=number, slack=slack, top=top), "kind int, front long, node long, round int, level int, head boolean")
    return cut(made)


def _eliminated(batches: Iterator[pd.DataFrame], number: int, slack: tuple[float, int], top: int | None) -> Iterator[pd.DataFrame]:
    """The rounds of `fronts` over nodes with their hash (kind 0), edges (1) and members of elements with their level (2)."""
    parts: dict[int, list[pd.DataFrame]] = {0: [], 1: [], 2: []}
    for batch in batches:
        for kind, rows in batch.groupby("kind"):
            parts[kind].append(rows)
    read = lambda kind, *names: [r for rows in parts[kind] for r in zip(*(rows[c].astype("int64").tolist() for c in names), strict=True)]
    mixed = dict(read(0, "a", "b"))
    edges: dict[int, set[int]] = {v: set() for v in mixed}
    of: dict[int, set[int]] = {v: set() for v in mixed}
    members: dict[int, set[int]] = {}
    level: dict[int, int] = {}
    for v, w in read(1, "a", "b"):
        edges[v].add(w)
    for e, v, deep in read(2, "a", "b", "level"):
        members.setdefault(e, set()).add(v)
        of[v].add(e)
        level[e] = deep
    out: list[tuple] = []

    def told(front: int, pivots: list[int], border: set[int], deep: int, inner: set[int]) -> None:
        out.extend((0, front, v, number, None, v == front) for v in pivots)
        out.extend((1, front, v, None, None, None) for v in border)
        out.append((2, front, None, None, deep, None))
        out.extend((3, e, front, None, None, None) for e in inner if top is None or e <= top)

    while edges:
        degree = {v: len(near) + sum(len(members[e]) - 1 for e in of[v]) for v, near in edges.items()}
        least = min(degree.values())
        if least >= DENSE * (len(edges) - 1):
            head = min(edges, key=lambda v: (degree[v], mixed[v], v))
            told(head, list(edges), set(), max((level[e] + 1 for e in members), default=0), set(members))
            break
        most = int(slack[0] * least) + slack[1]
        key = {v: (d, mixed[v], v) for v, d in degree.items() if d <= most}
        best: dict[int, tuple] = {}
        for v, k in key.items():
            for e in of[v]:
                best[e] = min(best.get(e, k), k)
        first = {v for v, k in key.items() if all(k <= key[w] for w in edges[v] if w in key)}
        heads = [v for v in first if all(best[e] == key[v] for e in of[v])]
        chosen = []
        for head in heads:
            inner = set(of[head])
            around = set().union(*(members[e] for e in inner)) - {head}
            pivots = [head, *(v for v in around if top is not None and v in first and of[v] <= inner)]
            chosen.append((head, pivots, (around | set().union(*(edges[v] for v in pivots))) - set(pivots), inner))
        for head, pivots, new, inner in chosen:
            level[head] = max((level[e] + 1 for e in inner), default=0)
            for e in inner:
                for v in members.pop(e):
                    of[v].discard(e)
            for v in pivots:
                for w in edges.pop(v):
                    edges[w].discard(v)
                del of[v]
            members[head] = new
            for v in new:
                of[v].add(head)
        for head, *_ in chosen:
            for v in members[head]:
                edges[v] -= members[head]
        for head, pivots, new, inner in chosen:
            along = [v for v in new if not edges[v] and len(of[v]) == 1]
            for v in along:
                del edges[v], of[v]
            members[head] = new.difference(along)
            told(head, [*pivots, *along], members[head], level[head], inner)
            if not members[head]:
                del members[head]
        number += 1
    if out:
        yield pd.DataFrame({c: pd.array([r[k] for r in out], dtype=kind) for k, (c, kind) in enumerate((("kind", "Int32"), ("front", "Int64"), ("node", "Int64"), ("round", "Int32"), ("level", "Int32"), ("head", "boolean")))})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def minimum_degree(pat: DataFrame, slack: tuple[float, int] = SLACK, groups: DataFrame | None = None) -> DataFrame:
    """(old, new): the order of `fronts`: by round, then front, its head first, then by id."""
    return ordered(fronts(pat, slack, groups))


def ordered(tree: Tree) -> DataFrame:
    rows = cut(tree.pivots.select("round", "front", (~F.col("head")).alias("late"), "node"))
    return prefix_sum(rows, ["round", "front", "late", "node"], F.lit(1).cast("long"), "new").select(F.col("node").alias("old"), "new")


FACTOR = "front long, pivots array<long>, border array<long>, w array<double>, c array<double>, parent long, s array<double>, b array<double>"


SENT = pa.schema([(k, pa.list_(pa.int64() if k in ("pivots", "border") else pa.float64()) if k not in ("front", "parent") else pa.int64()) for k in ("front", "pivots", "border", "w", "c", "parent", "s", "b")])


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by front -> a row for each front; those of a front may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        done = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and held[-1].column(0)[0].as_py() != ids[lo]:
                done.append(_front(held))
                held = []
            held.append(b.slice(lo, hi - lo))
        if done:
            yield pa.RecordBatch.from_pylist(done, SENT)
    if held:
        yield pa.RecordBatch.from_pylist([_front(held)], SENT)


def _front(rows: list[pa.RecordBatch]) -> dict:
    """One front: its pivots, border and parent (part 0), its own entries (1), right side (2) and the updates of its children (3)."""
    parts: dict[int, list[list[np.ndarray]]] = {k: [] for k in range(4)}
    for batch in rows:
        kinds, lists = batch.column(1).to_pylist(), [batch.column(k) for k in range(2, 6)]
        for r, kind in enumerate(kinds):
            parts[kind].append([c[r].values.to_numpy(zero_copy_only=False) for c in lists])
    ((pivots, border, _, parent),) = parts[0]
    p, ids = len(pivots), np.concatenate((pivots, border))
    order = np.argsort(ids)
    place = lambda x: order[np.searchsorted(ids[order], x)]
    f, b = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for i, j, v, _ in parts[1]:
        np.add.at(f, (place(i), place(j)), v)
    for i, _, _, x in parts[2]:
        np.add.at(b, place(i), x)
    for i, _, v, x in parts[3]:
        k = place(i)
        f[np.ix_(k, k)] += v.reshape(len(k), len(k))
        b[k] += x
    both = np.linalg.solve(f[:p, :p], np.column_stack((f[:p, p:], b[:p])))
    s, rest = f[p:, p:] - f[p:, :p] @ both[:, :-1], b[p:] - f[p:, :p] @ both[:, -1]
    return {"front": rows[0].column(0)[0].as_py(), "pivots": pivots, "border": border, "w": both[:, :-1].ravel(), "c": both[:, -1], "parent": int(parent[0]) if len(parent) else None, "s": s.ravel(), "b": rest}


def multifrontal(mat: DataFrame, rhs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(dof, val) with A x = b, by sparse LU over the assembly tree of A's pattern; A need not be symmetric.

    Pivots are sought inside a front's pivot block. Unknowns are those of `rhs` and of
    the matrix; one that the right side lacks counts as 0 there. Raises (in the task)
    LinAlgError if a block is singular. Memory of a task is the square of a front;
    rounds are the levels of the tree, up for the factors and down for the values.
    """
    mat = cut(mat.groupBy("row", "col").agg(F.sum("val").alias("val")))
    tree = tree or fronts(mat.select("row", "col").union(rhs.select("dof", "dof")))
    order = cut(ordered(tree))
    spots = tree.pivots.select("front", "node").join(order, F.col("node") == F.col("old")).select("front", "node", "new")
    spots = cut(spots.join(tree.levels, "front"))
    a, c = (spots.select(F.col("node").alias(k), F.col("front").alias(f"_f{k}"), F.col("new").alias(f"_n{k}")) for k in ("row", "col"))
    placed = mat.join(a, "row").join(c, "col").select(F.when(F.col("_nrow") < F.col("_ncol"), F.col("_frow")).otherwise(F.col("_fcol")).alias("front"), "row", "col", "val")
    none, reals = F.array().cast("array<long>"), F.array().cast("array<double>")
    cell = F.collect_list(F.struct("row", "col", "val")).alias("cells")
    own = placed.groupBy("front").agg(cell).select("front", F.lit(1).alias("part"), F.col("cells.row").alias("i"), F.col("cells.col").alias("j"), F.col("cells.val").alias("v"), reals.alias("b"))
    sides = rhs.join(spots.select(F.col("node").alias("dof"), "front"), "dof").groupBy("front").agg(F.collect_list(F.struct("dof", "val")).alias("cells"))
    sides = sides.select("front", F.lit(2).alias("part"), F.col("cells.dof").alias("i"), none.alias("j"), reals.alias("v"), F.col("cells.val").alias("b"))
    shape = tree.pivots.groupBy("front").agg(F.sort_array(F.collect_list("node")).alias("i"))
    shape = shape.join(tree.border.groupBy("front").agg(F.sort_array(F.collect_list("node")).alias("j")), "front", "left").join(tree.parents, "front", "left")
    shape = shape.select("front", F.lit(0).alias("part"), "i", F.coalesce("j", none).alias("j"), reals.alias("v"), F.when(F.col("parent").isNotNull(), F.array(F.col("parent").cast("double"))).otherwise(reals).alias("b"))
    parts = cut(shape.unionByName(own).unionByName(sides).join(tree.levels, "front"))
    done: list[DataFrame] = []
    waiting = None  # updates of fronts whose parents come later
    for level in range(tree.height + 1):
        now = parts.filter(F.col("level") == level).drop("level")
        if waiting is not None:
            here = tree.levels.filter(F.col("level") == level).select(F.col("front").alias("_f"))
            now = now.unionByName(waiting.join(here, F.col("front") == F.col("_f"), "left_semi"))
        made = cut(now.repartition("front").sortWithinPartitions("front").mapInArrow(_factored, FACTOR))
        done.append(made.select("front", "pivots", "border", "w", "c"))
        sent = made.filter("parent is not null").select(F.col("parent").alias("front"), F.lit(3).alias("part"), F.col("border").alias("i"), none.alias("j"), F.col("s").alias("v"), "b")
        if waiting is not None:
            sent = sent.unionByName(waiting.join(here, F.col("front") == F.col("_f"), "left_anti"))
        waiting = sent if level == 0 else cut(sent)
    x = None
    for made in reversed(done):
        rows = made
        if x is not None:
            known = made.select("front", F.posexplode("border").alias("k", "dof")).join(x, "dof").groupBy("front").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "val"))), lambda s: s["val"]).alias("x"))
            rows = made.join(known, "front", "left")
        else:
            rows = made.withColumn("x", reals)
        value = lambda c, k: c - F.aggregate(F.zip_with(F.slice("w", k * F.size("border") + 1, F.size("border")), F.coalesce("x", reals), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
        solved = rows.select("front", "pivots", F.transform("c", value).alias("val"))
        solved = solved.select(F.inline(F.arrays_zip(F.col("pivots").alias("dof"), "val")))
        x = cut(solved if x is None else x.unionByName(solved))
    return x
