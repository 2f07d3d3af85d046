"""SimHash near-duplicates, linked through BK-trees over shards of fingerprints.

1. One fingerprint for each text (Arrow batches; xxhash in C, bit counts in numpy).
2. Equal fingerprints are one row from here on, so exact copies cost nothing more.
3. A pair that differs in at most 4 of 64 bits agrees on at least two of six bands
   of bits; each fingerprint goes to the 15 shards of its pairs of bands. No pair
   is lost, and a shard's key has about 21 bits.
4. Each shard becomes a BK-tree from its first member on: children keyed by their
   distance to the parent; a search follows only edges within the radius of its own
   distance. Searches run in groups: all fingerprints that must enter a child go down
   together, as numpy vectors. A subtree whose members already are in the searchers'
   component is left, as no link there is new. What comes out is a star per
   component of a shard (a row per member at most), never the pairs.
5. Stars meet in a distributed connected-components loop (large star, small star). Its
   tables are cut before each join, so that a join's hot key can be split.

A tree holds a shard of fingerprints and never leaves its task: broadcasting trees,
as the method has it, would gather every fingerprint on the driver and send it to
every executor, which grows with the corpus, so the searchers come to the trees
through the shards' shuffle. Trees of a shard take its task's memory: 8 bytes for
each distinct fingerprint that shares two bands, and as much for its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORDS = 4
RADIUS = 4
SEED = 42
#: (first bit, bits) of the bands; two of six stay equal if four bits differ at most.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], ">u8")
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = np.concatenate(([0], ends[: len(parts) - words])).tolist()
        stops = (ends[words - 1 :] - 1).tolist()
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], ">u8")
    bits, step = np.zeros(64, np.int64), 1 << 16  # in blocks: a text of any length needs a few MB
    for i in range(0, len(hashes), step):
        bits += np.unpackbits(hashes[i : i + step].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"", words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


class BKTree:
    """Components of the fingerprints of one shard under the Hamming radius."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius, self.parent = fps, radius, np.arange(len(fps))
        stack = [(np.arange(len(fps)), np.empty(0, np.int64))]
        while stack:
            stack += self._node(*stack.pop())

    def roots(self, ids: np.ndarray) -> np.ndarray:
        r = self.parent[ids]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        self.parent[ids] = r
        return r

    def _link(self, a: int, others: np.ndarray) -> None:
        r = np.unique(self.roots(np.append(others, a)))
        self.parent[r] = r[0]

    def _node(self, members: np.ndarray, searchers: np.ndarray) -> list:
        """Link what members have among themselves and with searchers; returns the children to visit."""
        if len(searchers):
            rm, rs = self.roots(members), self.roots(searchers)
            if (rm == rm[0]).all():  # only a searcher of another component can bring a link
                searchers = searchers[rs != rm[0]]
                if not len(searchers):
                    return []
        if len(members) == 1 and not len(searchers):
            return []
        pivot, rest = members[0], members[1:]
        dm, ds = np.bitwise_count(self.fps[rest] ^ self.fps[pivot]), np.bitwise_count(self.fps[searchers] ^ self.fps[pivot])
        near = np.concatenate((rest[dm <= self.radius], searchers[ds <= self.radius]))
        if len(near):
            self._link(pivot, near)
        out = []
        for d in np.unique(dm):
            # a pair of two children is met once: the child farther out searches the nearer one
            outer = (dm > d) & (dm <= d + self.radius)
            inner = np.abs(ds.astype(np.int64) - int(d)) <= self.radius
            out.append((rest[dm == d], np.concatenate((rest[outer], searchers[inner]))))
        return out[::-1]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (shard, fp) -> (fp, root) for members of a component of at least two."""
    key, held = None, []

    def flush():
        fps = np.unique(np.concatenate(held)).view(np.uint64)
        if len(fps) < 2:
            return
        tree = BKTree(fps)
        root = fps[tree.roots(np.arange(len(fps)))]
        if (keep := root != fps).any():
            yield pa.RecordBatch.from_arrays([pa.array(fps[keep].view(np.int64)), pa.array(root[keep].view(np.int64))], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        keys, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        several = np.diff(bounds) > 1
        several[[0, -1]] = True  # these may go on in the batch before or after
        for i in np.flatnonzero(several):
            if keys[bounds[i]] != key:
                if held:
                    yield from flush()
                key, held = keys[bounds[i]], []
            held.append(fps[bounds[i] : bounds[i + 1]])
    if held:
        yield from flush()


def links(distinct: DataFrame, fp_col: str = "fp") -> DataFrame:
    """(u, v): links of distinct fingerprints, enough to connect all that the radius connects."""
    fp = F.col(fp_col)
    part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1)) for at, bits in BANDS]
    pairs = [(i, j) for i in range(len(BANDS)) for j in range(i)]
    shards = F.array(*[F.lit(k << 22) + F.shiftleft(part[i], 11) + part[j] for k, (i, j) in enumerate(pairs)])
    rows = distinct.select(F.explode(shards).alias("shard"), fp.alias("fp")).repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(_stars, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, root): connected components of (u, v), by alternating large and small stars.

    Each round keeps at most one row per edge; it ends when a round changes nothing,
    after about the logarithm of the longest path's length.
    """
    edges = common.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # every node keeps its own least neighbour
        large = common.cut(large.unionByName(low.filter("u > m").select("u", F.col("m").alias("v"))).distinct())
        low = common.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = common.cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least id that can be reached.

    Null and empty texts have fingerprint 0 and link like any other. Rows that
    repeat keep a row each. A null id never names a component unless all ids of it
    are null. An empty table gives an empty one. Extra columns are not read.
    """
    fps = common.cut(fingerprints(docs, id_col, text_col, words))
    distinct = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct))
    joined = common.cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = common.cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    named = common.cut(joined.join(least, "root").select(F.col("fp").alias("named_fp"), "component_id"))
    return fps.join(named, fps.fp == named.named_fp).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the document whose id names it.

    Rows that share an id are one document; the one with the least text stays. Rows
    with a null id cannot be named and all stay.
    """
    found = near_duplicates(docs.filter(F.col(id_col).isNotNull()), id_col, text_col, words)
    named = one_of_each(docs, found.filter("doc_id = component_id").select("doc_id"), id_col, text_col)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


def one_of_each(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of `docs` with the least text for each id of `kept`, a table of one column; the columns of `docs`."""
    own, n = common.fresh(docs, "_kept", "_n")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    return docs.join(kept.toDF(own).distinct(), F.col(id_col) == F.col(own)).withColumn(n, first).filter(F.col(n) == 1).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
