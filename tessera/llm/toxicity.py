"""Toxicity: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is a short list of English insults and what labelled rows teach: words
and word beginnings that are common in toxic documents and all but absent from
clean ones. It lies in a trie. A word that may be near a term (it shares the first
or the last half of one) becomes a Levenshtein automaton, and both are walked
together, so that terms with one letter wrong, too much, left out or swapped with
its neighbour match; letters parted by dots or stars (i.d.i.o.t) are read as a word.
A misspelling weighs less than the term, and counts only if it is no ordinary word
of clean documents, and for terms whose neighbours are rare there.

Each match is scored in its window of words: other matches and words of address
raise it; inside quotation marks, or where it is spoken about ("the word ...", "called
me ..."), it is told and not said, and does not add to the document. A logistic model over the
best, the sum and the rate of these scores, none of which may lower the result, and
fitted on the same rows, gives a document's score.

Fitting: about FIT_ROWS labelled rows of each class, none held out, reach the
driver. Scoring: one pass of Arrow batches over whole texts, no shuffle; the cache
of words met is bounded.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .language import grouped

FIT_ROWS = 2000
FIT_CHARS = 20_000
CACHED_WORDS = 300_000
WINDOW = 6
THRESHOLD = 0.7
#: A word or beginning is learned if it is in this share of the toxic documents and in so many, so many times likelier
#: there, and if chance would seldom make such counts (log-likelihood ratio).
LEAST_SHARE, LEAST_DOCS, LEAST_LIFT, LEAST_RATIO = 0.01, 4, 5, 20
#: Weight of a seed that the labelled rows do not have; bounds of all weights (log of the lift).
SEED_WEIGHT, LEAST_WEIGHT, MOST_WEIGHT = 4.0, 0.5, 5.0
STEMS = (4, 5, 6)
#: What a misspelled seed and a misspelled learned term weigh of the term; letters that a term has then at least; share of
#: clean documents in which misspellings of it may be met (in documents that the ordinary words were not taken from).
NEAR_SHARE, LEARNED_SHARE, NEAR_LETTERS, NEAR_RATE = 0.7, 0.35, 5, 0.001
#: A match's score grows by so much for each other match in its window, up to four, and with a word of address there; what is left of one that is quoted or spoken about.
PER_MATCH, PER_ADDRESS, QUOTED = 0.15, 0.3, 0.01

# English insults, and words of address.
SEEDS = "clown crap degenerate disgusting dumb filthy garbage idiot imbecile jerk loser moron pathetic scum scumbag stupid trash vermin worthless".split()
ADDRESS = frozenset("you your yours youre u ur du dich dein deine ihr euch tu toi ton te vous votre usted tú ti su ustedes vosotros".split())

#: Letters that single marks part are one word.
WORD = re.compile(r"(?<![^\W_])(?:[^\W_][.\-_*]){2,}[^\W_](?![^\W_])|[^\W_]+(?:[@$*][^\W_]+)*")
PARTED = re.compile(r"(?:[^\W_][.\-_*]){2,}[^\W_]")
RUN = re.compile(r"(.)\1+")
#: Marks that open a quotation and what closes it; straight ones open before a word and close after one.
PAIRS = {"«": "»", "“": "”", "„": "“”", "‘": "’", "‹": "›"}
MARK = re.compile("[«»“”„‘’‹›]|(?<![^\\s(\\[])[\"'](?=\\S)|(?<=\\S)[\"'](?![^\\s.,;:!?)\\]])|\n[ \t]*\n")
# Words that tell that a term is spoken about or was said by somebody, shortly before it or right after it.
REPORTING = frozenset("word words term called calls calling quote quoted slur wort begriff nannte nannten genannt beschimpft schimpfwort mot terme appelé appelée traité traitée insulte palabra término llamó llamaron llamado llamada insulto".split())
MEANING = frozenset("means meant comes refers bedeutet heißt stammt signifie désigne vient significa viene".split())
BEFORE, AFTER = 3, 2


def quotations(lower: str) -> list[tuple[int, int]]:
    """(start, end) of what stands between paired quotation marks, of any length, inside a paragraph; marks without a partner mean nothing."""
    found, opened = [], None
    for m in MARK.finditer(lower):
        mark = m[0]
        if mark[0] == "\n":
            opened = None
        elif opened is not None and mark in PAIRS.get(opened[0], opened[0]):
            found.append((opened[1], m.start()))
            opened = None
        elif opened is None and (mark in PAIRS or mark in "\"'" and (not m.start() or not lower[m.start() - 1].isalnum())):
            opened = mark, m.end()
    return found


def words_of(lower: str) -> list[str]:
    return [w if w.isalnum() else re.sub(r"[.\-_*]", "", w) if PARTED.fullmatch(w) else w for w in WORD.findall(lower)]


class Trie:
    """Terms with a weight; a term that ends in `*` is a beginning and matches any word that starts so.

    near: terms that forgive an edit; all whole ones of NEAR_LETTERS letters, if not
    given. ordinary: words that are no misspelling.
    """

    def __init__(self, weights: dict[str, float], near: frozenset[str] | None = None, ordinary: frozenset[str] = frozenset()):
        self.weights, terms, self.ordinary = weights, list(weights), ordinary
        self.near = frozenset(t for t in terms if not t.endswith("*") and len(t) >= NEAR_LETTERS) if near is None else near
        self.next: list[dict[str, int]] = [{}]
        self.term: list[tuple[str, ...]] = [()]  # the term that ends at a node, and the beginning
        self.terms = sorted(terms)
        for t in self.terms:
            node = 0
            for ch in t.rstrip("*"):
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.term.append(())
                node = self.next[node][ch]
            self.term[node] += (t,)
        # what a word must start or end with, by its length: an edit leaves the first or the last half of a term whole, or swaps across the middle
        self.stems = tuple(t[:-1] for t in self.terms if t.endswith("*"))
        whole = [t for t in self.terms if not t.endswith("*")]
        self.ends: dict[int, tuple[tuple[str, ...], tuple[str, ...]]] = {}
        for n in {len(t) + d for t in whole for d in (-1, 0, 1)}:
            forgiving = [t for t in whole if t in self.near and abs(len(t) - n) <= 1]
            heads = {t for t in whole if len(t) == n} | {t[: len(t) // 2] for t in forgiving}
            for t in forgiving:
                h = len(t) // 2
                heads.add(t[: h - 1] + t[h] + t[h - 1] + t[h + 1 :])
            self.ends[n] = tuple(heads), tuple({t[len(t) // 2 :] for t in forgiving})

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, ties to the greater weight."""
        heads, tails = self.ends.get(len(word), ((), ()))
        if not (word.startswith(self.stems) or word.startswith(heads) or word.endswith(tails)):
            return None
        machine = LevenshteinAutomaton(word)
        found, stack = None, [(0, machine.start())]
        while stack:
            node, state = stack.pop()
            for term in self.term[node]:
                d = machine.distance(state, term.endswith("*"))
                if d is not None and d <= (term in self.near) and (found is None or (d, -self.weights[term], term) < found):
                    found = d, -self.weights[term], term
            for ch, child in self.next[node].items():
                if after := machine.step(state, ch):
                    stack.append((child, after))
        if found is None or found[0] and word in self.ordinary:
            return None
        return found[2], found[0]


class LevenshteinAutomaton:
    """Accepts what is within `most` edits of a word; a swap of neighbours is one. A state: {(place in the word, whether amid a swap): least edits so far}."""

    def __init__(self, word: str, most: int = 1):
        self.word, self.most = word, most

    def start(self) -> dict[tuple[int, bool], int]:
        return {(i, False): i for i in range(min(self.most, len(self.word)) + 1)}

    def step(self, state: dict[tuple[int, bool], int], ch: str) -> dict[tuple[int, bool], int]:
        out: dict[tuple[int, bool], int] = {}
        word, n = self.word, len(self.word)
        for (i, swapping), e in sorted(state.items()):
            if swapping:
                moves = [((i + 2, False), e)] if word[i] == ch else []
            else:
                moves = [((i + 1, False), e if i < n and word[i] == ch else e + 1), ((i, False), e + 1)]
                if i + 1 < n and word[i + 1] == ch:
                    moves.append(((i, True), e + 1))
            for at, cost in moves:
                if at[0] <= n and cost <= self.most and cost < out.get(at, self.most + 1):
                    out[at] = cost
        for i in sorted(i for i, swapping in out if not swapping):  # letters of the word that are left out
            for j in range(i + 1, min(n, i + self.most - out[i, False]) + 1):
                out[j, False] = min(out.get((j, False), self.most + 1), out[i, False] + j - i)
        return out

    def distance(self, state: dict[tuple[int, bool], int], beginning: bool) -> int | None:
        """Edits at the end of a term; of a beginning, the rest of the word is free."""
        if beginning:
            return min((e for (_, swapping), e in state.items() if not swapping), default=None)
        return state.get((len(self.word), False))


FEATURES = ("best", "total", "rate")


class Scorer:
    """A trie of terms with weights, and the logistic model's weights: intercept first, then FEATURES."""

    def __init__(self, trie: Trie, weights: np.ndarray | None = None):
        self.trie = trie
        self.weights = np.array([-4.0, 0.8, 0.8, 0.3]) if weights is None else weights
        self.known: set[str] = set()
        self.hits: dict[str, tuple[int, float]] = {}

    def __reduce__(self):
        return Scorer, (self.trie, self.weights)

    def _found(self, word: str) -> tuple[str, int] | None:
        """(term, edits); a word with letters drawn out (stuuupid) is tried with each once, too, which is an edit."""
        found = self.trie.match(word)
        if found is None and (once := RUN.sub(r"\1", word)) != word and word not in self.trie.ordinary and (found := self.trie.match(once)):
            found = found[0], max(1, found[1])
        return found

    def look_up(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known, self.hits = set(), {}
        for w in words - self.known:
            if found := self._found(w):
                self.hits[w] = found[1], self.trie.weights[found[0]] * (1 if not found[1] else NEAR_SHARE if found[0] in SEEDS else LEARNED_SHARE)
        self.known |= words

    def matches(self, text: str) -> list[tuple[int, int, int, str, int, float]]:
        """(word's number, start, end, word, edits, score in its window) of each match in a text."""
        lower = text.lower()
        words = words_of(lower)
        self.look_up(set(words))
        at = [i for i, w in enumerate(words) if w in self.hits]
        spots = {i: (m.start(), m.end()) for i, m in enumerate(WORD.finditer(lower))} if at else {}
        return [(i, *spots[i], words[i], self.hits[words[i]][0], x) for i, x in zip(at, self._scores(lower, words, at), strict=True)]

    def _told(self, lower: str, words: list[str], at: list[int]) -> set[int]:
        """Numbers of the matches that are quoted or spoken about."""
        told = set()
        for i in at:
            if not REPORTING.isdisjoint(words[max(0, i - BEFORE) : i]) or not MEANING.isdisjoint(words[i + 1 : i + 1 + AFTER]):
                told.add(i)
        if spans := quotations(lower):
            starts = [a for a, _ in spans]
            inside = lambda at: (k := bisect(starts, at)) > 0 and at < spans[k - 1][1]
            told |= {i for i, m in enumerate(WORD.finditer(lower)) if words[i] in self.hits and inside(m.start())}
        return told

    def _scores(self, lower: str, words: list[str], at: list[int]) -> list[float]:
        """The matches' scores in their windows; of what is told, and not said, only QUOTED is left."""
        told, out = self._told(lower, words, at) if at else set(), []
        own = [i for i in at if i not in told]
        for i in at:
            near = bisect(own, i + WINDOW) - bisect(own, i - WINDOW - 1) - 1
            addressed = not ADDRESS.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1])
            out.append(QUOTED if i in told else self.hits[words[i]][1] * (1 + PER_MATCH * min(near, 4) + PER_ADDRESS * addressed))
        return out

    def features(self, text: str | None, words: list[str] | None = None) -> list[float]:
        lower = (text or "").lower()
        if words is None:
            words = words_of(lower)
            self.look_up(set(words))
        if not self.hits or self.hits.keys().isdisjoint(words):
            return [0.0] * len(FEATURES)
        scores = self._scores(lower, words, [i for i, w in enumerate(words) if w in self.hits])
        total = sum(x for x in scores if x > QUOTED)
        return [max(scores), np.log1p(total), np.log1p(1000 * total / len(words))]

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, features) of whole texts."""
        words = [words_of(t.lower()) if t else [] for t in texts]
        self.look_up(set().union(*words))
        x = np.array([self.features(t, w) for t, w in zip(texts, words, strict=True)])
        return 1 / (1 + np.exp(-(self.weights[0] + x @ self.weights[1:]))), x


def forgiving(weights: dict[str, float], docs: list[tuple[set[str], bool]]) -> Trie:
    """The trie of terms with what their misspellings may be, learned from documents (words, toxic).

    Ordinary words are those that clean documents have and toxic ones do not have much
    more often. A term forgives an edit if its misspellings beyond the ordinary words
    of one half of the clean documents are rare in the other half.
    """
    clean = [w for w, toxic in docs if not toxic]
    n1, n0 = max(len(docs) - len(clean), 1), max(len(clean), 1)
    count = {t: Counter(w for words, toxic in docs if toxic == t for w in words) for t in (True, False)}
    trie = Trie(weights)
    found = {w: hit for w in count[False] if (hit := trie.match(w)) and hit[1]}
    half = {w for words in clean[::2] for w in words}
    met = Counter(t for words in clean[1::2] for t in {found[w][0] for w in words if w in found and w not in half})
    near = frozenset(t for t in trie.near if met[t] <= NEAR_RATE * len(clean[1::2]))
    ordinary = frozenset(w for w in found if count[True][w] * n0 < LEAST_LIFT * count[False][w] * n1)
    return Trie(weights, near, ordinary)


def fit(rows: list[tuple[str, int]], seeds: list[str] = SEEDS) -> Scorer:
    """rows: (text, 1 if toxic). Without both classes: the seeds and fixed weights."""
    unique = {}
    for text, toxic in sorted(rows):  # one of each group of copies, by the least hash of five words
        w = words_of(text.lower())
        unique[min((crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))), default=0), toxic] = w, toxic, text
    texts = [t for _, _, t in unique.values()]
    docs = [(w, toxic) for w, toxic, _ in unique.values()]
    n1 = sum(t for _, t in docs)
    n0 = len(docs) - n1
    if not n1 or not n0:
        return Scorer(Trie(dict.fromkeys(seeds, SEED_WEIGHT)))
    count = {True: Counter(), False: Counter()}
    ways: dict[str, set[str]] = {}
    for words, toxic in docs:
        kinds = {w for w in words if len(w) >= 4}
        count[bool(toxic)].update(kinds | {w[:n] + "*" for w in kinds for n in STEMS if len(w) > n})
        if toxic:
            for w in kinds:
                for n in STEMS:
                    ways.setdefault(w[:n] + "*", set()).add(w)

    def weight(t: str) -> float:
        a, b = count[True][t], count[False][t]
        return float(np.clip(np.log((a + 0.1) / n1 * n0 / (b + 0.1)), LEAST_WEIGHT, MOST_WEIGHT))

    def telling(t: str) -> bool:
        a, b = count[True][t], count[False][t]
        if a < max(LEAST_DOCS, LEAST_SHARE * n1) or a * n0 < LEAST_LIFT * b * n1:
            return False
        share = n1 / (n1 + n0)
        ratio = 2 * (a * np.log(a / (share * (a + b))) + (b * np.log(b / ((1 - share) * (a + b))) if b else 0))
        return ratio >= LEAST_RATIO

    strong = {t for t in count[True] if telling(t)}
    stems = {t for t in strong if t.endswith("*") and len(ways[t]) >= 4}
    # of nested beginnings the longer one only where it tells clearly more
    stems = {t for t in stems if not any(t[:n] + "*" in stems and weight(t) < weight(t[:n] + "*") + 0.7 for n in STEMS if n < len(t) - 1)}
    learned = {t for t in strong if not t.endswith("*")}  # those with a learned beginning too: their misspellings may miss it
    terms = {t: weight(t) for t in stems | learned} | {t: SEED_WEIGHT for t in seeds if not count[True][t] and not count[False][t]}
    terms |= {t: weight(t) for t in seeds if count[True][t] and weight(t) > LEAST_WEIGHT}
    trie = forgiving(terms, [(set(w), bool(toxic)) for w, toxic in docs])
    _, x = Scorer(trie).score(texts)
    return Scorer(trie, logistic(x, np.array([t for _, t in docs], float), signs=np.ones(len(FEATURES))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 30, balanced: bool = True, signs: np.ndarray | None = None) -> np.ndarray:
    """Weights, intercept first, by Newton steps; balanced: both classes weigh the same.

    signs: for each feature 1 (its weight is not below 0), -1 or 0 (free); a weight
    that would go to the wrong side is 0, the one farthest off first.
    """
    if signs is not None:
        use = np.ones(x.shape[1], bool)
        while True:
            w = np.zeros(x.shape[1] + 1)
            w[np.append(True, use)] = logistic(x[:, use], y, l2, rounds, balanced)
            wrong = w[1:] * signs
            if wrong.min(initial=0) >= 0:
                return w
            use[wrong.argmin()] = False
    x = np.column_stack((np.ones(len(x)), x))
    w, weight = np.zeros(x.shape[1]), np.ones(len(y))
    if balanced:
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    ridge = np.diag([1e-6] + [l2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, fit_rows: int, fit_chars: int = FIT_CHARS) -> list[tuple[str, int]]:
    """(text, label) of about fit_rows rows of each class, not held out, of texts of at most fit_chars characters."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~common.is_held_out(F.col("doc_id"))).select("doc_id", F.col(label_col).alias("label")).distinct()
    top = [common.thinned(known.filter(F.col("label") == v), "doc_id", fit_rows) for v in (0, 1)]
    # two numbers in each of about 2 x fit_rows rows: bounded, so it can go to every task
    rows = docs.select("doc_id", "text").filter(F.length("text") <= fit_chars).join(F.broadcast(top[0].unionByName(top[1])), "doc_id").select("text", "label")
    return sorted((r.text, r.label) for r in common.first_rows(rows, 4 * fit_rows).collect())


def score_toxicity(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with toxicity (0 to 1), predicted (0 or 1) and toxic_best, the best match's score; columns of these names are replaced.

    Every row stays, repeated ones too. Null and empty texts, and those without a
    match, get the model's base score.
    """
    new = {"toxicity": "double", "predicted": "int", "toxic_best": "double"}
    rest = docs.drop(*new)
    at, shared = rest.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for part, texts in grouped(b, at):
                score, x = own.score(texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x[:, 0])], names=[*b.schema.names, *new])

    return rest.mapInArrow(run, common.wider(rest.schema, **new))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scorer = fit(training_rows(docs, common.table(spark, sf_dir, "labels"), "toxic", FIT_ROWS))
    scored = score_toxicity(docs.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "text"), scorer)
    return scored.select("doc_id", "held_out", F.col("toxicity").alias("score"), "predicted", "toxic_best")
