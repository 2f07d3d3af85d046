"""Near-duplicates by the share of common shingles: five words, Jaccard 0.8 or more.

The pipeline's stage. Candidates are what SimHash links through its BK-trees over shards
(simhash.links, fingerprints of five words). Two texts of Jaccard 0.8 differ in about 10
of 64 SimHash bits, though, and in 17 now and then; no bands of 64 bits find that radius
without comparing nearly all pairs. So MinHash bands add candidates that the trees'
radius leaves out, and every link of either kind is checked exactly.

1. Texts of equal shingle sets are one row (`node`, a 64-bit hash of the set), with the
   SimHash fingerprint of its least text; BK-trees link nodes within simhash.RADIUS bits.
2. BANDS bands of ROWS MinHash values; nodes that share a band are candidates. A pair
   of Jaccard exactly 0.8 shares none with a probability of (1 - 0.8^6)^40 = 5e-6, and
   more similar pairs with less. A band links its nodes to the least of them, never in pairs.
3. Components of candidates; the shingle sets of each are compared themselves (common
   shingles counted through posting lists), and what is at 0.8 or more is linked. Two
   texts that a true link joins share a candidate component.
4. A component of more than BLOCK texts is dealt into blocks, and each pair of its blocks
   is a group of its own: no task holds more than two blocks, and no pair is left out.
   Time grows with the square of such a component at worst.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WORDS = 5
BANDS, ROWS = 40, 6
#: Jaccard of at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
SEED = 42
#: Texts of a candidate component that are compared in one group at most (times two, if it has more).
BLOCK = 2000
#: Components of more than one block up to which their sizes go to every task.
BROADCAST_ROOTS = 50_000

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_MASKS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None]
_PLACES = _RANDOM.integers(0, 1 << 63, max(WORDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a UTF-8 text's shingles; shorter texts, empty ones too, are one shingle."""
    parts = text.lower().split()
    n = len(parts)
    if n <= WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    h = xxhash.xxh64_intdigest
    words = np.fromiter((h(p) for p in parts), np.uint64, n)
    out = np.zeros(n - WORDS + 1, np.uint64)
    for k in range(WORDS):
        out += words[k : n - WORDS + 1 + k] * _PLACES[k]
    return np.unique(_mixed(out))


def node_of(found: np.ndarray) -> int:
    """The signed 64-bit name of a shingle set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes(), SEED)).view(np.int64)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS signed longs; two sets agree in one if its ROWS MinHash values agree."""
    low, step = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), 2048
    for i in range(0, len(found), step):
        low = np.minimum(low, ((found[i : i + step] ^ _MASKS) * _FACTORS).min(1))
    rows = _mixed(low).reshape(BANDS, ROWS)
    return _mixed((rows * _PLACES[:ROWS]).sum(1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACES[0]).view(np.int64)


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each shingle set the index of its component's first one; links are pairs of NEAR or more."""
    m = len(sets)
    root, sizes = np.arange(m), np.array([len(s) for s in sets])
    if m < 2:
        return root
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owners = np.repeat(np.arange(m), sizes)[np.argsort(place, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(values)))))
    up, down = NEAR
    for i in range(m):
        other = np.flatnonzero(root != root[i])
        other = other[(other > i) & (sizes[other] * up <= sizes[i] * down) & (sizes[i] * up <= sizes[other] * down)]
        if not len(other):
            continue
        own = place[ends[i] - sizes[i] : ends[i]]
        common_ = np.bincount(np.concatenate([owners[starts[p] : starts[p + 1]] for p in own]), minlength=m)[other]
        # c / (a + b - c) >= up / down
        for r in np.unique(root[other[common_ * (up + down) >= (sizes[i] + sizes[other]) * up]]):
            a, b = sorted((int(r), int(root[i])))
            root[root == b] = a
    return root


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, fp, keys) for every row. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, keys = [], [], []
            for t in b.column(1):
                text = t.as_py() or b""
                found = shingles(text)
                nodes.append(node_of(found))
                fps.append(simhash.fingerprint(text, WORDS))
                keys.append(band_keys(found))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * BANDS, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists], names=["doc_id", "node", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, node long, fp long, keys array<long>")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, node, text) sorted by root -> (node, head) for nodes that are linked to another, the head."""
    root, held = None, {}

    def flush():
        nodes = np.array(list(held), np.int64)
        head = nodes[linked(list(held.values()))]
        if (keep := head != nodes).any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(head[keep])], names=["node", "head"])

    for b in batches:
        for r, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if r != root:
                yield from flush()
                root, held = r, {}
            if node not in held:
                found = shingles(text.as_py() or b"")
                if node_of(found) == node:  # rows that share an id can have other texts
                    held[node] = found
    yield from flush()


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without near-duplicates: of each component the document of the least id.

    Null and empty texts are duplicates of each other. Rows that share an id are one
    document; the one with the least text stays. Rows with a null id cannot be named
    and all stay. An empty table gives an empty one.
    """
    some = docs.filter(F.col(id_col).isNotNull())
    distinct = common.cut(sketches(some, id_col, text_col).groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    rows = distinct.select(F.explode("keys").alias("key"), "node")
    first = rows.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    edges = rows.join(first, "key").filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    named = common.cut(distinct.groupBy("fp").agg(F.min("node").alias("node")))
    trees = simhash.links(named.select("fp"))
    of = lambda end: named.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"))
    trees = trees.join(of("u"), "u").join(of("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    equal = distinct.select("fp", F.col("node").alias("u")).join(named.select("fp", F.col("node").alias("v")), "fp").filter("u <> v").select("u", "v")
    found = common.cut(simhash.components(edges.unionByName(trees).unionByName(equal)))  # without the roots themselves
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    large = common.cut(found.groupBy("root").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK))
    if large.count() <= BROADCAST_ROOTS:  # checked; beyond it the join is left to Spark
        large = F.broadcast(large)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    dealt = found.join(large, "root", "left").select("root", "node", F.explode(F.coalesce(others, alone)).alias("pair"))
    candidates = dealt.join(distinct.select("node", "least"), "node").select(F.xxhash64("root", "pair.i", "pair.j").alias("root"), "node", "least")
    texts = candidates.join(some.select(F.col(id_col).alias("least"), F.col(text_col).cast("binary").alias("text")), "least").select("root", "node", "text")
    links = texts.repartition("root").sortWithinPartitions("root").mapInArrow(_checked, "node long, head long")
    linked_to = simhash.components(links.select(F.col("node").alias("u"), F.col("head").alias("v")))
    heads = distinct.select("node", "least").join(linked_to, "node", "left").select(F.coalesce("root", "node").alias("head"), "least")
    kept = heads.groupBy("head").agg(F.min("least").alias("doc_id")).select("doc_id")
    return simhash.one_of_each(docs, kept, id_col, text_col).unionByName(docs.filter(F.col(id_col).isNull()))
