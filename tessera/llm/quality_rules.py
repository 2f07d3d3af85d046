"""Quality rules: gradient-boosted trees over document statistics.

One pass of Arrow batches computes the statistics of each whole text and scores
them with trees kept as flat numpy arrays; no shuffle. The trees are fitted on
about FIT_ROWS labelled documents, none held out; statistics of junk (symbols,
repeated lines and words, shouting) may only lower the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common

FIT_ROWS = 6000
#: A document is kept if its score is at least this.
KEEP_SCORE = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NEW = [*COUNTS, "base_failed", "quality_score", "kept"]
#: Statistics that the trees see, and how the score may move with each.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "digit_share": 0,
    "upper_share": -1,
    "exclaim_share": -1,
    "stop_share": 0,
    "words_a_line": 0,
    "distinct_share": 0,
    "top_share": -1,
}
MONOTONE = np.array(list(FEATURES.values()))
SPACES, SYMBOLS, DIGITS, UPPER, STOPS = b" \t\n\v\f\r", b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,;:"


def counted(text: str | None) -> tuple[list[int], list[float]]:
    """(COUNTS, values of FEATURES) of a text; null counts as empty."""
    text = text or ""
    b = text.encode()
    size, less = len(b), lambda chars: len(b) - len(b.translate(None, chars))
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    n, seen = len(words), {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeats = repeated(ids, len(seen))
    chars, symbols, dups = len(text) - less(SPACES), less(SYMBOLS), len(lines) - len(set(lines))
    top = int(np.bincount(ids).max()) if n else 0
    one, ch = max(n, 1), max(chars, 1)
    return [n, chars, symbols, dups, repeats], [
        np.log1p(n), chars / one, symbols / ch, dups / max(len(lines), 1), repeats / one, less(DIGITS) / ch, less(UPPER) / ch,
        b.count(b"!") / ch, less(STOPS) / one, n / max(len(lines), 1), len(seen) / one, top / one,
    ]


def repeated(ids: np.ndarray, kinds: int) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    if kinds < 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # pairs first, so that codes fit
        pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * kinds + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    hit, covered = (times > 1)[which], np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def base_fails(counts: np.ndarray) -> np.ndarray:
    n, repeats = counts[:, 0], counts[:, 4]
    return (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> boosting.Forest | None:
    """Trees from about `fit_rows` labelled documents that are not held out; None if both classes are not there."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.is_held_out(F.col("doc_id"))).select("doc_id", "quality")
    chosen = common.thinned(known.distinct(), "doc_id", fit_rows)
    # about fit_rows rows of two numbers: bounded, so it can go to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = rows.mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, f array<double>")
    rows = common.first_rows(rows, 2 * fit_rows).collect()
    if len({r.quality for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.f))
    return boosting.fit(np.array([r.f for r in rows]), np.array([r.quality for r in rows]), MONOTONE)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f = [counted(t)[1] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(f, pa.list_(pa.float64()))], names=["doc_id", "quality", "f"])


def apply_rules(docs: DataFrame, forest: boosting.Forest | None, text_col: str = "text", keep_score: float = KEEP_SCORE) -> DataFrame:
    """`docs` with COUNTS, base_failed, quality_score (0 to 1) and kept; columns of these names are replaced.

    Every row stays, repeated ones too. A null text counts as empty, and fails the
    base rules as it has fewer than MIN_WORDS words. Without trees (no labels of
    both classes) the score is 1 and the base rules decide.
    """
    rest, new = docs.drop(*NEW), NEW
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                both = [counted(t) for t in b.column(at).to_pylist()]
                counts, x = np.array([c for c, _ in both], np.int64), np.array([f for _, f in both])
                score = forest.predict(x) if forest else np.ones(len(x))
                failed = base_fails(counts)
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_score))], names=[*b.schema.names, *new])

    kinds = dict.fromkeys(COUNTS, "long") | {"base_failed": "boolean", "quality_score": "double", "kept": "boolean"}
    return rest.mapInArrow(run, common.wider(rest.schema, **kinds))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    forest = fit(docs, common.table(spark, sf_dir, "labels"))
    return apply_rules(docs.select("doc_id", "text"), forest).select("doc_id", *COUNTS, "base_failed", "kept", "quality_score")
