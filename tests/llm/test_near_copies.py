"""The pipeline's near-duplicate stage against a brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies

DOC = "doc_id long, text string"


def brute_force(texts: dict) -> set:
    """The least ids of the components of pairs whose 5-word shingles have Jaccard 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and least[i] != least[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    return set(least.values())


def edited(rng: random.Random, words: list, n: int) -> str:
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.random()}"
    return " ".join(out)


def test_stage_keeps_no_pair_at_eight_tenths(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts, at = {}, 0
    for length in (6, 12, 30, 60, 120, 250, 600):
        for _ in range(12):
            words = rng.choices(vocabulary, k=length)
            for n in (0, 0, *(rng.randint(1, max(1, length // 40)) for _ in range(3)), length // 8):
                texts[at := at + 1] = edited(rng, words, n)
    texts |= {9001: None, 9002: "", 9003: " \n", 9004: "one", 9005: "One", 9006: "a b c d e", 9007: "a b c d e f"}
    rows = list(texts.items())
    rng.shuffle(rows)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()}
    assert got == brute_force(texts)


def test_two_small_edits_in_a_long_text_are_one_document(spark):
    # Jaccard 0.92, but mostly over 4 bits
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(30):
        words = [f"w{rng.randrange(2000)}" for _ in range(248)]
        other = list(words)
        other[60], other[180] = "here", "there"
        rows += [(at, " ".join(words)), (at + 1, " ".join(other))]
        at += 2
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()}
    assert got == set(range(0, 60, 2))


def test_links_of_a_component_are_exact():
    # a chain: each neighbour is at 0.8 exactly or just below it
    base = np.arange(90, dtype=np.uint64)
    assert near_copies.linked([base, base + np.uint64(10)]).tolist() == [0, 0]  # 80 of 100
    assert near_copies.linked([base, base + np.uint64(11)]).tolist() == [0, 1]
    assert near_copies.linked([base, base + np.uint64(20), base + np.uint64(10), base + np.uint64(500)]).tolist() == [0, 0, 0, 3]


def test_repeated_and_null_ids(spark):
    rows = [(1, "b"), (1, "a"), (2, "a"), (None, "a"), (None, "a"), (3, "c")]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "a"), (0, "a"), (1, "a"), (3, "c")]


def test_trees_and_bands_both_propose(spark, monkeypatch):
    """Without bands, pairs within the trees' radius are still found; the exact check holds for both."""
    rng = random.Random(4)
    rows = []
    for at in range(0, 20, 2):
        words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        rows += [(at, " ".join(words)), (at + 1, " ".join([*words[:-1], "other"]))]
    monkeypatch.setattr(near_copies, "band_keys", lambda found: np.full(near_copies.BANDS, near_copies.node_of(found), np.int64))
    docs = spark.createDataFrame(rows, DOC)
    fps = {r.doc_id: r.fp for r in near_copies.sketches(docs, "doc_id", "text").collect()}
    near = {at for at in range(0, 20, 2) if ((fps[at] ^ fps[at + 1]) & ((1 << 64) - 1)).bit_count() <= 4}
    got = {r.doc_id for r in near_copies.deduplicated(docs).collect()}
    assert near and got == set(range(20)) - {at + 1 for at in near}
