"""Quality classifier by co-training two views of a document.

Text view: the whole text's words (their shares by hash) and make-up (pairs of
neighbouring character classes, repeats, distinct words and lines). Metadata view:
source, language and declared length, nothing that is read from the text. Each view
has its own classifier; over ROUNDS, each labels the documents of
an unlabelled pool that it is sure of, and they join the *other* view's training
rows. At the end each view is calibrated on labelled rows kept aside, the calibrated
views are combined there by a logistic model, and every document is scored.

Fitting: about FIT_ROWS labelled rows, none held out, and POOL_ROWS unlabelled ones
send their features (not their texts) to the driver. Scoring: one pass of Arrow
batches over whole texts, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting, common
from .toxicity import logistic

FIT_ROWS = 4000
POOL_ROWS = 6000
ROUNDS = 4
#: A pool document is labelled when a view's probability is at least this far from one half ...
SURE = 0.45
#: ... by so many at most a round and class, the surest first.
PER_ROUND = 300
THRESHOLD = 0.5
#: Labelled rows kept aside for calibration: one in so many.
ASIDE = 4
SOURCE_BUCKETS, LANG_BUCKETS, WORD_BUCKETS = 32, 8, 64

# Classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 sentence marks, 6 dashes and quotes, 7 symbols, 8 exclaiming, 9 beyond ASCII
CLASSES = np.full(256, 7, np.uint8)
for _class, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:", b"-'\"()", b"", b"!?", bytes(range(128, 256)))):
    CLASSES[list(_bytes)] = _class
KINDS = 10


def text_view(text: str | None) -> np.ndarray:
    b = (text or "").encode()
    codes = CLASSES[np.frombuffer(b, np.uint8)].astype(np.int64)
    pairs = np.bincount(codes[:-1] * KINDS + codes[1:], minlength=KINDS * KINDS) / max(len(b) - 1, 1)
    words, lines = b.split(), [x for x in b.split(b"\n") if x.strip()]
    n, kinds = max(len(words), 1), len(set(words))
    hashes = np.fromiter(map(crc32, map(bytes.lower, words)), np.uint32, len(words))
    by_word = np.bincount(hashes % WORD_BUCKETS, minlength=WORD_BUCKETS) / n
    return np.concatenate((pairs, by_word, [np.log1p(len(words)), len(b) / n, kinds / n, 1 - len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1)]))


def metadata_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(SOURCE_BUCKETS + LANG_BUCKETS + 4)
    out[crc32((source or "").encode()) % SOURCE_BUCKETS] = 1
    out[SOURCE_BUCKETS + crc32((lang or "").encode()) % LANG_BUCKETS] = 1
    out[-4:] = np.log1p(max(n_chars or 0, 0)), n_chars is None, source is None, lang is None
    return out


def _views(b: pa.RecordBatch, text: int, source: int, lang: int, chars: int) -> tuple[np.ndarray, np.ndarray]:
    rows = list(zip(*(b.column(i).to_pylist() for i in (text, source, lang, chars)), strict=True))
    return np.array([text_view(r[0]) for r in rows]), np.array([metadata_view(*r[1:]) for r in rows])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class CoTrained:
    """views: a forest each; platt: (intercept, slope) each; final: weights over the calibrated logits."""

    def __init__(self, views: list[boosting.Forest], platt: list[np.ndarray], final: np.ndarray, exchanged: list[tuple[int, int]]):
        self.views, self.platt, self.final, self.exchanged = views, platt, final, exchanged

    @classmethod
    def fit(cls, x: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained | None:
        """x, pool: features of both views; y: 0 or 1. None unless both classes are there, aside too."""
        aside = np.arange(len(y)) % ASIDE == 0
        if len(set(y[aside].tolist())) < 2 or len(set(y[~aside].tolist())) < 2:
            return None
        train = [(v[~aside], y[~aside]) for v in x]
        free = np.ones(len(pool[0]), bool)
        grow = lambda v: boosting.fit(*train[v], np.zeros(x[v].shape[1], int), trees=25)
        views, exchanged = [grow(0), grow(1)], []
        for _ in range(rounds):
            given = [_sure(views[v], pool[v], free) for v in (0, 1)]
            for v in (0, 1):
                at, label = given[1 - v]  # what the other view is sure of
                train[v] = np.concatenate((train[v][0], pool[v][at])), np.concatenate((train[v][1], label))
            exchanged.append((len(given[0][0]), len(given[1][0])))
            for at, _ in given:
                free[at] = False
            if not sum(exchanged[-1]):
                break
            views = [grow(0), grow(1)]
        logits = [_logit(views[v].predict(x[v][aside])) for v in (0, 1)]
        platt = [logistic(z[:, None], y[aside].astype(float), balanced=False) for z in logits]
        both = np.column_stack([p[0] + p[1] * z for p, z in zip(platt, logits, strict=True)])
        return cls(views, platt, logistic(both, y[aside].astype(float), balanced=False), exchanged)

    def score(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, metadata view), calibrated probabilities of quality 1."""
        z = [p[0] + p[1] * _logit(f.predict(v)) for p, f, v in zip(self.platt, self.views, x, strict=True)]
        return _sigmoid(self.final[0] + np.column_stack(z) @ self.final[1:]), _sigmoid(z[0]), _sigmoid(z[1])


def _sure(forest: boosting.Forest, pool: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pool):
        return np.empty(0, int), np.empty(0)
    p = forest.predict(pool)
    out = []
    for label in (0, 1):
        sure = np.flatnonzero(free & ((p - 0.5) * (2 * label - 1) >= SURE))
        out.append(sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][:PER_ROUND])
    return np.concatenate(out), np.concatenate([np.full(len(a), float(label)) for label, a in enumerate(out)])


COLUMNS = ("text", "source", "lang", "n_chars")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> CoTrained | None:
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.is_held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    # two numbers in each of about fit_rows rows: bounded, so it can go to every task
    chosen = F.broadcast(common.thinned(known, "doc_id", fit_rows))
    pooled = common.thinned(docs.filter(~common.is_held_out(F.col("doc_id"))), "doc_id", pool_rows)
    rows = common.first_rows(_featured(docs.join(chosen, "doc_id").select("doc_id", "label", *COLUMNS)), 2 * fit_rows).collect()
    free = common.first_rows(_featured(pooled.join(chosen, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("label"), *COLUMNS)), 2 * pool_rows).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.label, crc32(str(r.doc_id).encode()), r.a))  # both classes are spread over the rows kept aside
    free.sort(key=lambda r: (crc32(str(r.doc_id).encode()), r.a))
    pool = [np.array([r[k] for r in free]).reshape(len(free), len(rows[0][k])) for k in ("a", "b")]
    return CoTrained.fit([np.array([r.a for r in rows]), np.array([r.b for r in rows])], np.array([r.label for r in rows]), pool)


def _featured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = [pa.array(list(v), pa.list_(pa.float64())) for v in _views(b, 2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *both], names=["doc_id", "label", "a", "b"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, label int, a array<double>, b array<double>")


def classify(docs: DataFrame, model: CoTrained | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score, text_score, metadata_score (0 to 1) and predicted; columns of these names are replaced.

    Null texts count as empty, a null source or language is a value of its own, a
    null n_chars is marked as such. Every row stays, repeated ones too. Without a
    model (labels of one class at most) scores are null and every row is predicted 1.
    """
    new = {"score": "double", "text_score": "double", "metadata_score": "double", "predicted": "int"}
    rest = docs.drop(*new)
    if model is None:
        return rest.withColumns({c: F.lit(None).cast("double") for c in list(new)[:3]} | {"predicted": F.lit(1)})
    at, shared = [rest.columns.index(c) for c in COLUMNS], docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                scores = shared.value.score(list(_views(b, *at)))
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, scores), pa.array((scores[0] >= threshold).astype(np.int32))], names=[*b.schema.names, *new])

    return rest.mapInArrow(run, common.wider(rest.schema, **new))


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    held = common.is_held_out(F.col("doc_id")).alias("held_out")
    return classify(docs.select("doc_id", held, *COLUMNS), model).select("doc_id", "held_out", "score", "text_score", "metadata_score", "predicted")
