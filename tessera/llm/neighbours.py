"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

Largest inner product becomes least distance by one component more, which brings
all vectors to the length of the longest. The tree is fitted on a sample that grows
with the vectors, one in SAMPLE_EVERY and never over MOST_FIT (so its size is bounded
and it can be broadcast): leaves keep their size until then. Every vector is indexed.
A search keeps a priority queue of branches by distance to their centres and opens
leaves until the calibrated number is reached (the least number at which sample
queries, held against brute force over all rows, find TARGET of their neighbours)
and the opened leaves hold enough vectors.

Neighbouring leaves lie together in cells of about CELL_ROWS vectors; a leaf that is
larger is dealt over several. A query goes to each cell once, with the leaves that it
opened there. A cell that many queries open is copied for every PART_QUERIES of them,
so a group is bounded on both sides. Equal vectors are one point that carries its
smallest ids, so a vector that a third of the rows share costs what one does.

Rows compared for a query are the opened leaves' rows. On clustered vectors few leaves
hold the neighbours at any size; on vectors without any structure, where the nearest
are hardly nearer than the rest, recall needs a fixed share of all leaves, and the
work then grows with rows times queries whatever the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 20
#: Vectors that the tree is fitted on: one in so many, between these bounds.
SAMPLE_EVERY, LEAST_FIT, MOST_FIT = 8, 8192, 131_072
BRANCHES = 8
LEAF_SAMPLE = 32
CALIBRATION_QUERIES = 128
TARGET = 0.97
CELL_ROWS, PART_QUERIES = 4096, 16_384
#: Cells up to which their table goes to every task (a row has two numbers).
BROADCAST_CELLS = 200_000


class Tree:
    """Centres of a hierarchical k-means tree; a node's children are a list of nodes, a leaf has a number."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 11):
        self.longest, self.rng = longest, np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []  # of each inner node's children
        self.children: list[np.ndarray] = []  # >= 0: inner node; < 0: leaf -1-x
        self.leaves = 0
        self._grow(self.lift(sample))
        del self.rng

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return np.column_stack((x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))))

    def _grow(self, x: np.ndarray) -> int:
        if len(x) <= LEAF_SAMPLE or (x == x[0]).all():
            if not self.centres:  # a tree of one leaf
                self.centres.append(x[:1] if len(x) else np.zeros((1, x.shape[1])))
                self.children.append(np.array([-1]))
                self.leaves = 1
                return 0
            self.leaves += 1
            return -self.leaves
        me = len(self.centres)
        self.centres.append(np.empty(0))
        self.children.append(np.empty(0))
        centres = x[self.rng.choice(len(x), min(BRANCHES, len(x)), replace=False)]
        for _ in range(12):
            near = distances(x, centres).argmin(1)
            centres = np.stack([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
        near = distances(x, centres).argmin(1)
        used = np.unique(near)
        if len(used) == 1:  # does not part further
            used, near = np.array([0, 1]), (np.arange(len(x)) >= len(x) // 2).astype(int)
            centres = np.stack([x[near == j].mean(0) for j in used])
            self.centres[me], self.leaves = centres, self.leaves + 2
            self.children[me] = np.array([1 - self.leaves, -self.leaves])
            return me
        self.centres[me] = centres[used]
        self.children[me] = np.array([self._grow(x[near == j]) for j in used])
        return me

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        x, node = self.lift(x), np.zeros(len(x), np.int64)
        while len(inner := np.unique(node[node >= 0])):
            for n in inner:
                at = np.flatnonzero(node == n)
                node[at] = self.children[n][distances(x[at], self.centres[n]).argmin(1)]
        return -1 - node

    def best_leaves(self, query: np.ndarray, most: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: `most` of them, and more until they hold `least` points by `sizes`."""
        q = np.append(query * (self.longest / np.linalg.norm(query)), 0.0)
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < least):
            _, n = heapq.heappop(queue)
            if n < 0:
                found.append(-1 - n)
                held += sizes.get(-1 - n, 0) if sizes else 0
                continue
            d = ((self.centres[n] - q) ** 2).sum(1)
            for item in zip(d.tolist(), self.children[n].tolist(), strict=True):
                heapq.heappush(queue, item)
        return found


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * x @ c.T


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of rows that take part: an id, and a vector of finite components that is not zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _top(scores: np.ndarray, ids: np.ndarray, sizes: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, score, id) of each query's k best, ties to smaller ids.

    scores: queries by points, -inf where a query does not look; ids: of all points in turn, `sizes` each; own: the queries' ids.
    """
    most = min(k + 1, scores.shape[1])
    edge = np.partition(scores, -most, axis=1)[:, -most]
    who, point = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    n, starts = sizes[point], (np.cumsum(sizes) - sizes)[point]
    who, score = np.repeat(who, n), np.repeat(scores[who, point], n)
    found = ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    other = found != own[who]
    who, score, found = who[other], score[other], found[other]
    order = np.lexsort((found, -score, who))
    who, score, found = who[order], score[order], found[order]
    first = np.searchsorted(who, who, "left")
    best = np.arange(len(who)) - first < k
    return who[best], score[best], found[best]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of `queries`, nearest first.

    Both tables: an integer id and an array of numbers. Rows with a null id, or a
    vector that is null, empty, zero or holds null or non-finite components take no
    part, nor do vectors of another than the most common length (ties: the longer).
    A query's own row, and any row of the same id, is no candidate; rows that
    repeat are candidates each, a repeated query is asked once. Fewer candidates
    than k: all there are, as leaves are opened until they hold k. An empty table
    gives an empty result. Extra columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes["d"])
    first = Window.partitionBy("v").orderBy("vec_id")
    points = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = common.cut(points)
    n_points, longest = points.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) ** 0.5).first()
    fit_rows = min(max(LEAST_FIT, n_points // SAMPLE_EVERY), MOST_FIT)
    hashed, total = points.select("v", F.xxhash64("v").alias("h")), n_points
    sample = _matrix(common.thinned(hashed, "h", fit_rows, total).select("v").limit(2 * fit_rows).toArrow().column(0).combine_chunks())
    tree = Tree(sample[np.lexsort(sample.T)], longest)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.leaf_of(_matrix(b.column(0))).astype(np.int32)), *b.columns], names=["leaf", "v", "ids"])

    index = common.cut(points.mapInArrow(place, "leaf int, v array<double>, ids array<long>"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = common.cut(valid(queries, id_col, vector_col).filter(F.size("v") == sizes["d"]).select(F.col("vec_id").alias("query_id"), "v").distinct().repartition(parts, "query_id"))
    visits = _calibrated(index, asked, tree, k, target)
    held = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}  # a row per leaf of the tree
    cells = _cells(held)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, cell, opened = [], [], []
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else ()):
                by_cell: dict[int, list[int]] = {}
                for leaf in shared.value.best_leaves(q, visits, held, k + 1):
                    first, n = cells.get(leaf, (0, 0))
                    for c in range(first, first + n):
                        by_cell.setdefault(c, []).append(leaf)
                who += [i] * len(by_cell)
                cell += by_cell.keys()
                opened += by_cell.values()
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(opened, pa.list_(pa.int32())), b.column(0).take(at), b.column(1).take(at)], names=["cell", "leaves", "query_id", "v"])

    routed = common.cut(asked.mapInArrow(route, "cell int, leaves array<int>, query_id long, v array<double>"))
    opened = routed.groupBy("cell").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("parts"))
    if sum(n for _, n in cells.values()) <= BROADCAST_CELLS:  # checked; beyond it the joins are left to Spark
        opened = F.broadcast(opened)
    asks = routed.join(opened, "cell").select("cell", F.pmod(F.xxhash64("query_id"), F.col("parts").cast("long")).cast("int").alias("part"), "query_id", "v", "leaves")
    where = F.broadcast(spark.createDataFrame([(leaf, *c) for leaf, c in cells.items()], "leaf int, first int, n int"))  # a row per leaf of the tree
    stored = index.join(where, "leaf").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("n").cast("long"))).cast("int"))
    stored = stored.join(opened, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "leaf", "v", "ids")

    def scan(asks: pa.Table, held: pa.Table) -> pa.Table:
        out: list = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        if asks.num_rows and held.num_rows:
            x, ids = _matrix(held.column("v").combine_chunks()).T.copy(), held.column("ids").combine_chunks()
            flat, n_ids = ids.flatten().to_numpy(), ids.value_lengths().to_numpy().astype(np.int64)
            leaves, leaf_at = np.unique(held.column("leaf").to_numpy(), return_inverse=True)
            own, q, looks = asks.column("query_id").to_numpy(), _matrix(asks.column("v").combine_chunks()), asks.column("leaves").combine_chunks()
            for lo in range(0, len(own), 256):
                hi = min(lo + 256, len(own))
                part = looks.slice(lo, hi - lo)
                open_ = np.zeros((hi - lo, len(leaves) + 1), bool)
                which = part.flatten().to_numpy()
                at = np.minimum(np.searchsorted(leaves, which), len(leaves) - 1)
                open_[np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy()), np.where(leaves[at] == which, at, len(leaves))] = True
                scores = np.where(open_[:, leaf_at], q[lo:hi] @ x, -np.inf)
                who, score, vec = _top(scores, flat, n_ids, own[lo:hi], k)
                out.append((own[lo:hi][who], score, vec))
        who, score, vec = map(np.concatenate, zip(*out, strict=True))
        return pa.table({"query_id": who, "vec_id": vec, "score": score})

    keys = ("cell", "part")
    found = asks.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _cells(held: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Leaf: (its first cell, cells that it is dealt over). Leaves next to each other in the tree share a cell until it is full."""
    out, cell, rows = {}, 0, 0
    for leaf in sorted(held):
        if rows and rows + held[leaf] > CELL_ROWS:
            cell, rows = cell + 1, 0
        n = -(-held[leaf] // CELL_ROWS)
        out[leaf] = cell, n
        cell, rows = (cell + n, 0) if n > 1 else (cell, rows + held[leaf])
    return out


def _calibrated(index: DataFrame, asked: DataFrame, tree: Tree, k: int, target: float) -> int:
    """Leaves to open, from sample queries held against brute force over the whole index."""
    rows = sorted(common.sample_rows(asked, "query_id", CALIBRATION_QUERIES))
    if not rows:
        return 1
    q = np.array([r.v for r in rows])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s, leaves = q @ _matrix(b.column(1)).T, b.column(0).to_numpy()
            at = np.argpartition(s, -min(k + 1, s.shape[1]), axis=1)[:, -min(k + 1, s.shape[1]) :]
            who = np.repeat(np.arange(len(q)), at.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(who.astype(np.int32)), pa.array(s[who, at.ravel()]), pa.array(leaves[at.ravel()])], names=["q", "score", "leaf"])

    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    # k + 1 for each sample query, its own point among them
    true = index.mapInArrow(brute, "q int, score double, leaf int").withColumn("n", best).filter(F.col("n") <= k + 1).select("q", "leaf").collect()
    order = [{leaf: i for i, leaf in enumerate(tree.best_leaves(v, tree.leaves))} for v in q]
    needed = np.sort([order[r.q][r.leaf] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
