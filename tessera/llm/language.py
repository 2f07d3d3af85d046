"""Language identification with a linear-chain conditional random field over words.

Words are runs of letters. A word's emission scores come from hashed features
(affixes and all trigrams of its letters, the word itself as a lexicon entry); transitions
between the languages of neighbouring words are learned with them, on windows of
which half are spliced from two languages, so that code-switched text is labelled
word by word. Forward-backward gives each word's marginals; a document's language
is the one with the largest expected share of its words.

Fitting: about FIT_DOCS rows of known language, none held out, reach the driver, as
many of each language as there are, up to an equal share of them, and
WINDOWS_A_DOC windows of WINDOW words spread over each are learned from;
the model has BUCKETS rows of one weight per language and is broadcast (a few MB).
Scoring is one pass of Arrow batches, without a shuffle; whole texts are read, in
groups of GROUP_CHARS characters, and the cache of word scores is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FIT_DOCS = 3000
MOST_LANGS = 500
#: Documents longer than this are not fitted on (they are scored whole).
FIT_CHARS = 20_000
BUCKETS = 1 << 17
WINDOW = 32
WINDOWS_A_DOC = 4
GROUP_CHARS = 2_000_000
CACHED_WORDS = 120_000
#: Features in memory at a time: of a word, and of words that are scored together.
PIECE, GROUP_FEATURES = 1 << 16, 1 << 20
UNKNOWN = "und"
#: What the pipeline asks of a document to keep it.
KEEP_SCORE = 0.4

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def feature_pieces(word: str) -> Iterator[list[int]]:
    """Hashed features: whole word, affixes of one to three letters, all trigrams, PIECE of them at a time."""
    w, edged = word.encode(), f"<{word}>"
    found = [crc32(w, 1)]
    for n in (2, 3, 4):
        found += [crc32(edged[:n].encode(), 2), crc32(edged[-n:].encode(), 3)]
    last = len(edged) - 2
    narrow = len(w) == len(word)  # ASCII: letters are bytes
    edged = f"<{word}>".encode() if narrow else edged
    for lo in range(0, last, PIECE):
        places = range(lo, min(lo + PIECE, last))
        yield found + ([crc32(edged[i : i + 3], 4) for i in places] if narrow else [crc32(edged[i : i + 3].encode(), 4) for i in places])
        found = []


def features(word: str) -> list[int]:
    return list(chain.from_iterable(feature_pieces(word)))


def gathered(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """Emission scores of words, a row each. About GROUP_FEATURES are held at a time, however long a word is."""
    out = np.zeros((len(words), weights.shape[1]), weights.dtype)
    each, at, held = [], [], 0

    def add() -> None:
        flat = np.fromiter(chain.from_iterable(each), np.int64, held) & (len(weights) - 1)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in each])[:-1])).astype(np.int64)
        np.add.at(out, at, np.add.reduceat(weights[flat], starts, axis=0))

    for i, word in enumerate(words):
        for piece in feature_pieces(word):
            each.append(piece)
            at.append(i)
            held += len(piece)
            if held >= GROUP_FEATURES:
                add()
                each, at, held = [], [], 0
    if each:
        add()
    return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of each word, their sums by sequence).

    scores: rows of all sequences in turn; lengths: at least 1 each; moves[i, j],
    start: log weights. All sequences advance together; the longest ones last.
    """
    k, order = scores.shape[1], np.argsort(-lengths, kind="stable")
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    long = lengths[order]
    active = np.searchsorted(-long, -np.arange(long[0]), "left")
    off = np.concatenate(([0], np.cumsum(active)))
    step = np.repeat(np.arange(long[0]), active)
    place = at[np.arange(off[-1]) - off[:-1][step]] + step
    p = scores[place]
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    a, alpha = np.exp(moves - moves.max()), np.empty_like(p)
    cur = np.exp(start - start.max()) * p[: active[0]]
    cur /= cur.sum(1, keepdims=True)
    alpha[: active[0]] = cur
    for t in range(1, long[0]):
        lo, hi = off[t], off[t + 1]
        cur = (cur[: hi - lo] @ a) * p[lo:hi]
        cur /= cur.sum(1, keepdims=True)
        alpha[lo:hi] = cur
    back, at_b = np.ones((0, k)), a.T.copy()
    for t in range(long[0] - 1, -1, -1):
        lo, hi = off[t], off[t + 1]
        if len(back):
            back = (p[off[t + 1] : off[t + 2]] * back) @ at_b
            back /= back.sum(1, keepdims=True)
        if len(back) < hi - lo:
            back = np.concatenate((back, np.ones((hi - lo - len(back), k))))
        alpha[lo:hi] *= back
    alpha /= alpha.sum(1, keepdims=True)
    p[place] = alpha  # in place of the scores, which are not needed any more
    return p, np.add.reduceat(p, np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64), axis=0)


class Crf:
    """langs (sorted), weights (BUCKETS x langs), moves (langs x langs), start."""

    def __init__(self, langs: list[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.langs, self.weights, self.moves, self.start = langs, weights, moves, start

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], epochs: int = 3, batch: int = 256, rate: float = 0.3, seed: int = 7) -> Crf | None:
        """rows: (text, language). None if there is nothing to learn from."""
        rng = np.random.default_rng(seed)
        langs = sorted({lang for _, lang in rows})
        spans: list[tuple[list[str], int]] = []
        for text, lang in rows:
            w = words_of(text)
            for i in range(min(WINDOWS_A_DOC, (len(w) + WINDOW - 1) // WINDOW)):
                # windows spread over the whole document
                lo = i * max(0, len(w) - WINDOW) // max(1, WINDOWS_A_DOC - 1)
                spans.append((w[lo : lo + WINDOW], langs.index(lang)))
        spans = [s for s in spans if s[0]]
        if not spans:
            return None
        k = len(langs)
        half, pure = WINDOW // 2, list(spans)
        spans = [(w, [y] * len(w)) for w, y in pure]
        for i, j in zip(range(0, len(pure), 2), rng.integers(0, len(pure), len(pure)).tolist(), strict=False):  # splice halves
            (wa, ya), (wb, yb) = pure[i], pure[j]
            spans[i] = wa[:half] + wb[:half], [ya] * len(wa[:half]) + [yb] * len(wb[:half])
        vocab: dict[str, int] = {}
        seqs = [(np.array([vocab.setdefault(x, len(vocab)) for x in w]), np.array(y)) for w, y in spans]
        feats = [(np.array(features(w)) & (BUCKETS - 1)).astype(np.int32) for w in vocab]
        weights, moves, start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k)
        g2 = [np.full((BUCKETS, k), 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)]
        for _ in range(epochs):
            order = rng.permutation(len(seqs))
            for b in range(0, len(order), batch):
                part = [seqs[i] for i in order[b : b + batch]]
                ids, y = np.concatenate([x for x, _ in part]), np.concatenate([y for _, y in part])
                lengths = np.array([len(x) for x, _ in part])
                types, inverse = np.unique(ids, return_inverse=True)
                flat = np.concatenate([feats[t] for t in types])
                sizes = np.array([len(feats[t]) for t in types])
                scores = np.add.reduceat(weights[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)[inverse].astype(float)
                post, _ = forward_backward(scores, lengths, moves, start)
                grad = post.copy()
                grad[np.arange(len(y)), y] -= 1
                by_type = np.stack([np.bincount(inverse, grad[:, c], len(types)) for c in range(k)], 1)
                used, where = np.unique(flat, return_inverse=True)
                spread = np.repeat(by_type, sizes, axis=0)
                gw = np.stack([np.bincount(where, spread[:, c], len(used)) for c in range(k)], 1).astype(np.float32) / len(y)
                g2[0][used] += gw**2
                weights[used] -= rate * gw / np.sqrt(g2[0][used])
                first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                inner = np.setdiff1d(np.arange(len(y)), first)
                # expected moves from neighbouring marginals against those seen
                seen, meant = np.zeros((k, k)), post[inner - 1].T @ post[inner]
                np.add.at(seen, (y[inner - 1], y[inner]), 1)
                for p, (w, g) in enumerate(((moves, (meant - seen) / len(y)), (start, grad[first].mean(0)))):
                    g2[p + 1] += g**2
                    w -= rate * g / np.sqrt(g2[p + 1])
        return cls(langs, weights, moves, start)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (expected share of words, 0 to 1) of whole texts."""
        return Labeller(self).label(texts)

    def label_words(self, text: str) -> list[tuple[str, str]]:
        """(word, language) along a text: the most likely language of each word."""
        w = words_of(text)
        if not w:
            return []
        post, _ = forward_backward(gathered(self.weights, w).astype(float), np.array([len(w)]), self.moves, self.start)
        return [(x, self.langs[i]) for x, i in zip(w, post.argmax(1).tolist(), strict=True)]


class Labeller:
    """Labels groups of texts; keeps the scores of words met, CACHED_WORDS at most before it starts anew."""

    def __init__(self, crf: Crf):
        self.crf, self.ids, self.scores = crf, {}, np.empty((0, len(crf.langs)), np.float32)

    def _scores(self, flat: list[str]) -> np.ndarray:
        new = list(set(flat).difference(self.ids))
        if len(self.ids) + len(new) > CACHED_WORDS:
            self.ids, self.scores, new = {}, self.scores[:0], list(set(flat))
        if new:
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.scores = np.concatenate((self.scores, gathered(self.crf.weights, new)))
        return self.scores[np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))].astype(float)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) if t else [] for t in texts]
        has = [i for i, w in enumerate(words) if any(any(map(str.isalpha, x)) for x in w)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if has:
            lengths = np.array([len(words[i]) for i in has])
            _, sums = forward_backward(self._scores(list(chain.from_iterable(words[i] for i in has))), lengths, self.crf.moves, self.crf.start)
            share = np.clip(sums / lengths[:, None], 0, 1)
            for i, best, row in zip(has, share.argmax(1).tolist(), share, strict=True):
                langs[i], scores[i] = self.crf.langs[best], float(row[best])
        return langs, scores


def grouped(batch: pa.RecordBatch, at: int, limit: int = GROUP_CHARS, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list]]:
    """A batch in groups of about `limit` characters of its column `at`, each with that column's values.

    Few rows become Python strings at a time; a text longer than the limit is a group with its neighbours.
    """
    lo, texts, total = 0, [], 0
    for first in range(0, batch.num_rows, rows):
        more = batch.column(at).slice(first, rows).to_pylist()
        texts += more
        total += sum(len(t or "") for t in more)
        if total >= limit or first + rows >= batch.num_rows:
            yield batch.slice(lo, len(texts)), texts
            lo, texts, total = lo + len(texts), [], 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Crf | None:
    """A model of about `fit_docs` rows (never over twice that) with a language and words that are not held out.

    Of more than MOST_LANGS values of the language the most frequent ones are learned.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & ~common.is_held_out(F.col(id_col))).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.filter(F.length("text") <= FIT_CHARS)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return None
    left, langs, parts, share = fit_docs, len(sizes), 1 << 30, {}
    for lang, n in sorted(sizes.items(), key=lambda x: x[1]):  # what small languages leave goes to the larger ones
        want = min(n, max(left // langs, 1))
        share[lang], left, langs = parts if want == n else int(parts * want / n), left - want, langs - 1
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col("doc_id")), F.lit(parts)) < bound)
    rows = common.first_rows(chosen, 2 * fit_docs + MOST_LANGS).collect()
    return Crf.fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text, r.lang))])


def identify(docs: DataFrame, crf: Crf | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the language and score of each row, in two columns more (of these names, any before are replaced).

    Null texts and those without a letter: `und`, 0. All rows are kept. Without a
    model (no labelled rows) every row is `und`.
    """
    rest = docs.drop(pred_col, score_col)
    if crf is None:
        return rest.withColumns({pred_col: F.lit(UNKNOWN), score_col: F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(crf)
    at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        for b in batches:
            for part, texts in grouped(b, at):
                langs, scores = labeller.label(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, pred_col, score_col])

    return rest.mapInArrow(run, common.wider(rest.schema, **{pred_col: "string", score_col: "double"}))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    crf = fit(docs)
    return identify(docs.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "text"), crf).select("doc_id", "held_out", "lang_pred", "score")
