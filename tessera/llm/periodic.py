"""Runs of a text's words: maximal stretches that repeat with a period.

A suffix automaton of the words has a state for each set of end positions that some
substrings share. Going up its suffix links, the ordered end positions of a state are
those of its children and its own; sets are merged small into large. Where a merge
makes two positions neighbours, at a distance d not over the state's length, the
state's longest string ends at both and they overlap or touch: a square of period d,
which is extended both ways to a run. For every run of period q the two occurrences of
its part that is q shorter are such neighbours, at the state where they first meet, so
no run is missed; a stretch found by several periods has the least of them.

Before, words that cannot lie in a run are put aside, exactly: every word of a run of
LEAST words or more and two periods is inside a GRAM-gram that comes again in the text
(a run of length n and period q has equal GRAM-grams at its first n - q - GRAM + 1
places and q later, and both copies cover it, as n >= q + GRAM). Only stretches of
covered words become automata.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has at least LEAST words, and two periods.
LEAST = 12
#: LEAST // 2: the largest length for which the filter above loses no run.
GRAM = 6
#: Positions in a piece of an ordered set.
PIECE = 1024


class Ordered:
    """An ordered set of positions, in pieces of bounded length."""

    def __init__(self, x: int):
        self.pieces, self.heads, self.n = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for p in self.pieces:
            yield from p

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Puts x in; returns its neighbours."""
        k = max(bisect_left(self.heads, x) - 1, 0)
        piece = self.pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else None
        after = piece[at] if at < len(piece) else self.heads[k + 1] if k + 1 < len(self.heads) else None
        piece.insert(at, x)
        self.heads[k] = piece[0]
        self.n += 1
        if len(piece) > PIECE:
            self.pieces[k : k + 1] = [piece[: PIECE // 2], piece[PIECE // 2 :]]
            self.heads[k : k + 1] = [piece[0], piece[PIECE // 2]]
        return before, after


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton: its length, suffix link and end position (-1: a clone has none of its own)."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(ids):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, end


def squares(ids: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares, at least one in every run: neighbours that end positions become on the way up the links."""
    length, link, end = automaton(ids)
    held: list[Ordered | None] = [Ordered(e) if e >= 0 else None for e in end]
    order = np.argsort(-np.array(length), kind="stable").tolist()
    for state in order[:-1]:  # the root has no string
        own, up = held[state], link[state]
        held[state] = None
        if not up:
            continue
        into = held[up]
        if into is None:
            held[up] = own
            continue
        if into.n < own.n:
            own, into = into, own
        held[up] = into
        for x in own:
            before, after = into.add(x)
            if before is not None and x - before <= length[up]:
                yield x, x - before
            if after is not None and after - x <= length[up]:
                yield after, after - x


def _reach(same: np.ndarray, at: int, step: int) -> int:
    """How far `same` holds from `at` on, going by `step`, in stretches that double."""
    n, width = 0, 64
    while True:
        part = same[at + n : at + n + width] if step > 0 else same[max(at - n - width + 1, 0) : max(at - n + 1, 0)][::-1]
        stop = np.flatnonzero(~part)
        if len(stop):
            return n + int(stop[0])
        n += len(part)
        if len(part) < width:
            return n
        width *= 2


def _runs_of(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch of word numbers."""
    known: dict[int, list[tuple[int, int]]] = {}  # by period: (start, end) of what is extended already, ordered
    least: dict[tuple[int, int], int] = {}
    for at, q in squares(ids.tolist()):
        mine = known.setdefault(q, [])
        k = bisect_left(mine, (at - q + 1, 0))  # stretches of one period share fewer than q words, so the last that starts before is the one
        if k and mine[k - 1][1] >= at and mine[k - 1][0] <= at - 2 * q + 1:
            continue
        lag = _Lag(ids, q)
        left, right = _reach(lag, at - q, -1), _reach(lag, at - q + 1, 1)
        start, stop = at - q - left + 1, at + right
        insort(mine, (start, stop))
        if stop - start + 1 >= max(LEAST, 2 * q):
            least[start, stop] = min(q, least.get((start, stop), q))
    for (start, stop), q in least.items():
        yield start, stop - start + 1, q


class _Lag:
    """ids[i] == ids[i + q], worked out for slices only."""

    def __init__(self, ids: np.ndarray, q: int):
        self.ids, self.q, self.n = ids, q, len(ids) - q

    def __getitem__(self, s: slice) -> np.ndarray:
        lo, hi = min(s.start, self.n), min(s.stop, self.n)
        return self.ids[lo:hi] == self.ids[lo + self.q : hi + self.q]


def covered(ids: np.ndarray) -> np.ndarray:
    """True for words inside a GRAM-gram that the text has twice (or one of equal hash, which costs time only)."""
    n = len(ids) - GRAM + 1
    marks = np.zeros(len(ids) + 1, np.int64)
    if n > 1:
        h = np.zeros(n, np.uint64)
        for k in range(GRAM):
            h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        again = h[order][1:] == h[order][:-1]
        at = np.concatenate((order[1:][again], order[:-1][again]))
        np.add.at(marks, at, 1)
        np.add.at(marks, at + GRAM, -1)
    return np.cumsum(marks)[:-1] > 0


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text's words, by start, then period."""
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(ids) < LEAST or len(numbers) == len(ids):
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered(ids), [False])).astype(np.int8)))
    found = []
    for lo, hi in edges.reshape(-1, 2).tolist():
        if hi - lo >= LEAST:
            found += [(lo + s, n, q) for s, n, q in _runs_of(ids[lo:hi])]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in found:
        drop[s + q] += 1
        drop[s + n] -= 1
    if not found:
        return b" ".join(words)
    return b" ".join(w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: runs is an array of (start, length, period), collapsed a text.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A null or empty text has no words, no
    runs and an empty collapsed text. Rows that repeat, and rows that share an id, keep a
    row each; a null id stays null. An empty table gives an empty one. Other columns are
    not read. A text of any length is one task's work; its automaton takes some hundred
    bytes for each word that the filter leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "runs", "collapsed"]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            sizes, lists, texts = [], [], []
            for t in b.column(1):
                words = (t.as_py() or b"").split()
                found = runs(words)
                sizes.append(len(words))
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(lists, kind), pa.array(texts, pa.binary())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(text: Column, doc_id: Column) -> Column:
    """The contract's texts: where crc32(doc_id) is a multiple of 10, the words from a on repeat with a period. A null id: as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1)).cast("long")).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", best)
    period = -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

