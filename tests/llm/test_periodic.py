"""Runs of words against brute force over all stretches and periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import periodic

SF = Path("/root/testdata/sf0.001")


def brute(words: list, least: int = periodic.LEAST) -> list:
    """Every maximal stretch of each period; of equal stretches the least period."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                if i - start + q >= max(least, 2 * q):
                    found.setdefault((start, i - 1 + q), q)
                start = i + 1
    return sorted(((s, e - s + 1, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_fast(words: list) -> list:
    """The same by whole arrays, for long texts."""
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found: dict = {}
    for q in range(1, len(ids) // 2 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for lo, hi in edges[edges[:, 1] - edges[:, 0] + q >= max(periodic.LEAST, 2 * q)].tolist():
            found.setdefault((lo, hi - 1 + q), q)
    return sorted(((s, e - s + 1, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_random_words_of_small_alphabets():
    rng = random.Random(1)
    for trial in range(300):
        words = rng.choices("abc"[: 1 + trial % 3], k=rng.randrange(70))
        assert periodic.runs(words) == brute(words) == brute_fast(words), words


def test_repeats_inside_repeats():
    rng = random.Random(2)
    for _ in range(60):
        unit = rng.choices("abcdefgh", k=rng.randrange(1, 9))
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += rng.choices("vwxyz", k=rng.randrange(12)) + unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit) + 1)]
        words = words * rng.randrange(1, 4)
        assert periodic.runs(words) == brute(words), words


def test_long_texts():
    assert periodic.runs(["a"] * 50_000) == [(0, 50_000, 1)]
    unit = [str(i) for i in range(9_000)]
    assert periodic.runs(unit + unit + unit[:10]) == [(0, 18_010, 9_000)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 1_500:  # Fibonacci words have the most runs
        a, b = b, b + a
    assert periodic.runs(b) == brute(b)


def test_shortest_runs_and_neighbours():
    twelve = list("abcdef") * 2
    assert periodic.runs(twelve) == [(0, 12, 6)]
    assert periodic.runs(twelve[:-1]) == []
    assert periodic.runs(["x", *twelve, "x"]) == [(1, 12, 6)]
    assert periodic.runs(list("ab") * 6) == [(0, 12, 2)]
    assert periodic.runs([]) == []
    assert periodic.collapsed([b"x"] + [b"a", b"b"] * 6 + [b"y"], [(1, 12, 2)]) == b"x a b y"


def wanted(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_fast(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.skipif(not SF.exists(), reason="no driver tables here")
def test_query_on_all_documents(spark):
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(SF)).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == sorted(wanted(d.doc_id, d.text) for d in docs)


def test_odd_rows_and_tables(spark, tmp_path):
    kind = "doc_id long, text string, runs string, n_words int"
    rows = [(i, " a\tb" * 20 + "\x0bc\x1c", "x", 1) for i in range(40)] + [(7, None, None, None), (7, None, None, None), (None, "a " * 30, None, 2), (8, "", "", 0), (9, " \n ", "", 0), (10, "ä ö " * 15, "", 0)]
    table = spark.createDataFrame(rows, kind)
    for name, part in (("rows", table), ("none", table.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path / "rows")).collect()), key=key)
    assert got == sorted((wanted(r[0], r[1]) for r in rows), key=key)
    assert periodic.op11_periodic_runs(spark, str(tmp_path / "none")).count() == 0
    found = periodic.periodic_runs(table.filter("doc_id = 1")).first()
    assert found.collapsed == "a b c\x1c" and [tuple(r) for r in found.runs] == [(0, 40, 2)]
