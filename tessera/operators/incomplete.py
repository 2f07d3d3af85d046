"""Incomplete LU by levels of block rows, and its application.

Rows are cut into blocks of BLOCK consecutive ones. A block depends on the blocks before it
that its entries name; a level is all blocks whose dependencies are done. One round
factors a level: each block gets the finished rows that it names and is eliminated row
by row on its own pattern. A solve goes over the same levels, down and up. No task holds more than a
block and the rows it names; rounds are the length of the longest chain of blocks, so an
order that bounds chains (several colours, or minimum degree) keeps them few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import sparsity
from tessera.session import cut

#: Rows of a block.
BLOCK = 64
#: Entries of a block on average, where its rows are chosen by them: long chains then cross few blocks.
ENTRIES = 1 << 17
CHUNK = "brow long, i array<long>, j array<long>, v array<double>"
_CHUNK = pa.schema([("brow", pa.int64()), ("i", pa.list_(pa.int64())), ("j", pa.list_(pa.int64())), ("v", pa.list_(pa.float64()))])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each value of the first column of sorted batches, as dicts."""
    held: list[dict] = []
    key = None
    for b in batches:
        names = b.schema.names
        for r in range(b.num_rows):
            first = b.column(0)[r].as_py()
            if first != key and held:
                yield held
                held = []
            key = first
            held.append({n: b.column(k)[r].values.to_numpy(zero_copy_only=False) if pa.types.is_list(b.schema.types[k]) else b.column(k)[r].as_py() for k, n in enumerate(names)})
    if held:
        yield held


def _by_row(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    edges = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
    return {int(i[a]): (j[a:b], v[a:b].copy()) for a, b in zip(edges, edges[1:], strict=False) if b > a}


def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(brow, part, i, j, v) sorted by brow -> the block's factors; part 0: its own entries, 1: finished rows that it names."""
    for rows in _grouped(batches):
        done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in rows:
            if r["part"]:
                done |= _by_row(r["i"], r["j"], r["v"])
        (own,) = (r for r in rows if not r["part"])
        mine = _by_row(own["i"], own["j"], own["v"])
        for row in sorted(mine):
            cols, vals = mine[row]
            for at in range(int(np.searchsorted(cols, row))):
                k = int(cols[at])
                up, right = done.get(k, (cols[:0], vals[:0]))
                d = int(np.searchsorted(up, k))
                if d == len(up) or up[d] != k or right[d] == 0:
                    raise ZeroDivisionError(f"pivot {k} vanishes")
                vals[at] /= right[d]
                places = np.searchsorted(cols, up[d + 1 :])
                inside = places < len(cols)
                inside[inside] = cols[places[inside]] == up[d + 1 :][inside]
                vals[places[inside]] -= vals[at] * right[d + 1 :][inside]
            done[row] = cols, vals
        kept = sorted(mine)
        flat = {"i": np.concatenate([np.full(len(mine[r][0]), r) for r in kept]), "j": np.concatenate([mine[r][0] for r in kept]), "v": np.concatenate([mine[r][1] for r in kept])}
        yield pa.RecordBatch.from_pylist([{"brow": rows[0]["brow"], **flat}], _CHUNK)


def _levels(chunks: DataFrame, lower: bool, block: int) -> tuple[DataFrame, int]:
    """((brow, level), number of levels): the longest chain of blocks that a block's entries below (or above) the diagonal lead to."""
    bcol = F.floor(F.col("col") / block)
    deps = chunks.select("brow", F.explode("j").alias("col")).select("brow", bcol.alias("on")).distinct()
    waiting = cut(deps.filter("on < brow" if lower else "on > brow"))
    done = cut(chunks.select("brow").join(waiting.select("brow"), "brow", "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while waiting.take(1):
        level += 1
        ready = waiting.join(done.select(F.col("brow").alias("on"), F.lit(1).alias("ok")), "on", "left").groupBy("brow").agg((F.count("*") == F.count("ok")).alias("ready")).filter("ready")
        new = cut(ready.select("brow", F.lit(level).alias("level")))
        done = cut(done.unionByName(new))
        waiting = cut(waiting.join(new, "brow", "left_anti"))
    return done, level + 1


def block_rows(rows: DataFrame, entries: int = ENTRIES) -> int:
    """Rows of a block of consecutive ones that has about so many entries of (row, col)."""
    n, first, last = rows.agg(F.count("*"), F.min("row"), F.max("row")).first()
    return max(1, (last - first + 1) * entries // n) if n else 1


def chunked(rows: DataFrame, block: int) -> DataFrame:
    """(row, col, val) as a row for each block of rows: (brow, i, j, v)."""
    cells = F.collect_list(F.struct("row", "col", "val")).alias("cells")
    return rows.groupBy(F.floor(F.col("row") / block).alias("brow")).agg(cells).select("brow", F.col("cells.row").alias("i"), F.col("cells.col").alias("j"), F.col("cells.val").alias("v"))


def factors(mat: DataFrame, pat: DataFrame, block: int = BLOCK) -> DataFrame:
    """(brow, i, j, v): L (below the diagonal, its own diagonal being 1) and U (the rest) on the pattern (row, col), by blocks of rows.

    Raises ZeroDivisionError (in the task) if a pivot is missing or 0.
    """
    own = cut(chunked(sparsity.merge_copy(pat, mat), block))
    level_of, levels = _levels(own, True, block)
    parts = own.join(level_of, "brow").withColumn("part", F.lit(0))
    deps = own.select("brow", F.explode("j").alias("col")).select("brow", F.floor(F.col("col") / block).alias("on")).distinct().filter("on < brow").join(level_of, "brow")
    parts, deps = cut(parts), cut(deps)
    out: DataFrame | None = None
    for level in range(levels):
        now = parts.filter(F.col("level") == level).select("brow", "part", "i", "j", "v")
        if out is not None:
            named = deps.filter(F.col("level") == level).select("brow", "on").join(out.withColumnRenamed("brow", "on"), "on")
            now = now.unionByName(named.select("brow", F.lit(1).alias("part"), "i", "j", "v"))
        made = now.repartition("brow").sortWithinPartitions("brow").mapInArrow(_factored, CHUNK)
        out = cut(made if out is None else out.unionByName(made))
    return out


def split(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(L with its diagonal, U) as (row, col, val)."""
    flat = chunks.select(F.inline(F.arrays_zip(F.col("i").alias("row"), F.col("j").alias("col"), F.col("v").alias("val"))))
    unit = flat.select("row").distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("val"))
    return flat.filter("row > col").unionByName(unit), flat.filter("row <= col")


def _substituted(lower: bool, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(brow, i, j, v, dof, b) sorted by brow: the block's own triangle and right side -> its values."""
        for rows in _grouped(batches):
            for r in rows:
                x = dict(zip(r["dof"].tolist(), r["b"].tolist(), strict=True))
                entries = _by_row(r["i"], r["j"], r["v"])
                for row in sorted(entries, reverse=not lower):
                    cols, vals = entries[row]
                    off = cols < row if lower else cols > row
                    value = x.get(row, 0.0) - sum(a * x.get(c, 0.0) for c, a in zip(cols[off].tolist(), vals[off].tolist(), strict=True))
                    if not unit:
                        d = int(np.searchsorted(cols, row))
                        if d == len(cols) or cols[d] != row or vals[d] == 0:
                            raise ZeroDivisionError(f"pivot {row} is missing or zero")
                        value /= vals[d]
                    x[row] = value
                kept = sorted(entries)
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([x[k] for k in kept], pa.float64())], names=["dof", "val"])

    return run


def applied(chunks: DataFrame, block: int = BLOCK) -> Callable[[DataFrame], DataFrame]:
    """A function r -> x with L U x = r over the factors; rows that r lacks count as 0. Two rounds of jobs for each level of blocks."""
    return substituted(chunks, (True, False), block)


def substituted(chunks: DataFrame, ways: tuple[bool, ...], block: int, unit_lower: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A function r -> x that solves with the lower (True) or upper (False) triangle of the chunks, one after the other. `unit_lower`: the lower one's diagonal is 1."""
    chunks = cut(chunks)
    flat = chunks.select("brow", F.inline(F.arrays_zip(F.col("i").alias("row"), F.col("j").alias("col"), F.col("v").alias("val"))))
    same = F.floor(F.col("col") / block) == F.col("brow")
    off, inner = cut(flat.filter(~same)), cut(chunked(flat.filter(same), block))
    sides = []
    for lower in ways:
        level_of, levels = _levels(chunks, lower, block)
        away = cut(off.filter("col < row" if lower else "col > row").join(level_of, "brow").select("level", "row", "col", "val"))
        sides.append((lower, levels, cut(inner.join(level_of, "brow")), away))

    def apply(r: DataFrame) -> DataFrame:
        for lower, levels, triangles, away in sides:
            b, x = r if lower != ways[0] or levels == 1 else cut(r.select("dof", "val")), None  # on the way up r is written already
            for level in range(levels):
                left = b
                if x is not None:
                    known = away.filter(F.col("level") == level).join(x.select(F.col("dof").alias("col"), F.col("val").alias("x")), "col")
                    left = b.unionByName(known.select(F.col("row").alias("dof"), (-F.col("val") * F.col("x")).alias("val")))
                own = left.withColumn("brow", F.floor(F.col("dof") / block)).groupBy("brow", "dof").agg(F.sum("val").alias("b")).groupBy("brow").agg(F.collect_list(F.struct("dof", "b")).alias("s"))
                now = triangles.filter(F.col("level") == level).join(own, "brow", "left")
                now = now.select("brow", "i", "j", "v", F.coalesce(F.col("s.dof"), F.array().cast("array<long>")).alias("dof"), F.coalesce(F.col("s.b"), F.array().cast("array<double>")).alias("b"))
                made = now.mapInArrow(_substituted(lower, lower and unit_lower), "dof long, val double")
                x = cut(made if x is None else x.unionByName(made))
            r = x
        return r

    return apply
