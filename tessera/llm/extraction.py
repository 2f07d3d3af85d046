"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks. Features of a block: its ancestors' tags, the words
of their class and id names, and its text (length, links, punctuation, place on the
page). The field has two labels, main or not, with learned transitions between
neighbouring blocks; it is fitted on FIT_PAGES labelled pages and decoded by
Viterbi. One pass of Arrow batches over whole pages, no shuffle; the model is a
small dictionary of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html_blocks import Block, blocks
from .labelled_pages import labelled
from .language import forward_backward

FIT_PAGES = 1500
EPOCHS = 6


@lru_cache(maxsize=20_000)
def _place(kinds: frozenset[str], leaf: str, section: str, names: frozenset[str]) -> tuple[str, ...]:
    return (
        *("t:" + t for t in kinds), "leaf:" + leaf, "in:" + section, *("n:" + n for n in names),
        *("in-n:" + section + n for n in names), f"within:{section}:{not kinds.isdisjoint(('article', 'main'))}",
    )


def features(b: Block, total: int) -> list[str]:
    n, words = len(b.text), b.text.count(" ") + 1
    ends = sum(map(b.text.count, ".!?"))
    f = [
        "bias", f"len:{min(9, int(log(n + 1)))}", f"words:{min(7, int(log(words + 1) * 1.5))}", f"link:{int(b.linked * 4)}",
        f"ends:{min(4, ends)}", f"stop:{b.text[-1] in '.!?:;…”\"'}", f"rate:{min(5, int(40 * ends / (words + 1)))}",
        f"at:{4 * b.index // max(total, 1)}", f"first:{b.index == 0}", f"last:{b.index == total - 1}",
    ]
    if "©" in b.text:
        f.append("copyright")
    if b.hidden:
        f.append("hidden")
    if b.bold:
        f.append("bold")
    f += _place(b.kinds, b.leaf, b.section, b.names)
    return f


class BlockCrf:
    """weights: (feature -> (other, main)); moves: log weights [from][to]; start."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[float]], start: list[float]):
        self.weights, self.moves, self.start = weights, moves, start
        self.known = frozenset(f.partition(":")[2] for f in weights if f.startswith(("t:", "n:")))

    @classmethod
    def fit(cls, pages: list[tuple[str, set[str]]], epochs: int = EPOCHS, rate: float = 0.2, batch: int = 50, seed: int = 3) -> BlockCrf:
        names: dict[str, int] = {}
        seqs = []
        for html, main in pages:
            found = blocks(html)
            if found:
                seqs.append(([np.array([names.setdefault(x, len(names)) for x in features(b, len(found))]) for b in found], np.array([b.text in main for b in found], int)))
        w, moves, start = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
        g2 = [np.full_like(x, 1e-3) for x in (w, moves, start)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(seqs))
            for lo in range(0, len(order), batch):
                part = [seqs[i] for i in order[lo : lo + batch]]
                feats, y = [x for s, _ in part for x in s], np.concatenate([y for _, y in part])
                lengths = np.array([len(s) for s, _ in part])
                flat, sizes = np.concatenate(feats), np.array([len(x) for x in feats])
                scores = np.add.reduceat(w[flat], np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0)
                post, _ = forward_backward(scores, lengths, moves, start)
                grad = post.copy()
                grad[np.arange(len(y)), y] -= 1
                first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                inner = np.setdiff1d(np.arange(len(y)), first)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[inner - 1], y[inner]), 1)
                gw = np.zeros_like(w)
                np.add.at(gw, flat, np.repeat(grad, sizes, axis=0))
                for v, g, s in zip((w, moves, start), (gw / batch + 1e-4 * w, (post[inner - 1].T @ post[inner] - seen) / batch, grad[first].sum(0) / batch), g2, strict=True):
                    s += g**2
                    v -= rate * g / np.sqrt(s)
        return cls({k: (float(w[i, 0]), float(w[i, 1])) for k, i in names.items()}, moves.tolist(), start.tolist())

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: which blocks are main."""
        (oo, om), (mo, mm) = self.moves
        best_o, best_m, back, none = self.start[0], self.start[1], [], (0.0, 0.0)
        for i, b in enumerate(found):
            pairs = [self.weights.get(f, none) for f in features(b, len(found))]
            eo, em = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
            if i:
                from_o, from_m = best_o + oo >= best_m + mo, best_o + om >= best_m + mm
                back.append((from_o, from_m))
                best_o, best_m = (best_o + oo if from_o else best_m + mo), (best_o + om if from_m else best_m + mm)
            best_o, best_m = best_o + eo, best_m + em
        out, main = [], best_m > best_o
        for step in [*reversed(back), None]:
            out.append(main)
            if step:
                main = not step[1] if main else not step[0]
        return out[::-1] if found else []

    def text(self, html: str | None) -> str:
        found = blocks(html, self.known)
        return "\n".join(b.text for b, main in zip(found, self.decode(found), strict=True) if main)


def extract(pages: DataFrame, crf: BlockCrf, html_col: str = "html") -> DataFrame:
    """`pages` without the html, with text and n_chars (its code points); columns of these names are replaced.

    White space in a block is one space, blocks are joined by a line break. Null,
    empty and textless pages: empty text, 0. Every row stays, repeated ones too;
    broken markup is read as far as it goes.
    """
    new = {"text": "string", "n_chars": "long"}
    rest = [c for c in pages.columns if c not in (*new, html_col)]
    shared = pages.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf_ = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                texts = [crf_.text(h) for h in b.column(len(rest)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*rest, *new])

    kept = pages.select(*rest)
    return pages.select(*rest, F.col(html_col)).mapInArrow(run, common.wider(kept.schema, **new))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), BlockCrf.fit(labelled(FIT_PAGES))).select("page_id", "url", "text", "n_chars")
