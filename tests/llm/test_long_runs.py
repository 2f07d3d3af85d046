"""Language of runs of letters without spaces, of any length."""

from __future__ import annotations

import random

import numpy as np

from tessera.llm import language


def test_all_trigrams_of_a_long_run_count():
    rng = random.Random(5)
    syllables = {"xx": ["漢", "字", "文", "本"], "yy": ["ひ", "ら", "が", "な"]}
    run = lambda lang, n: "".join(rng.choices(syllables[lang], k=n))
    crf = language.Crf.fit([(" ".join(run(lang, 12) for _ in range(20)), lang) for lang in syllables for _ in range(60)])
    # the same first 39 bytes and the same last letters; only the middle tells
    for lang, other in (("xx", "yy"), ("yy", "xx")):
        texts = [run(other, 13) + run(lang, 60) + run(other, 2) for _ in range(20)]
        assert crf.label(texts)[0] == [lang] * 20


def test_scores_of_a_word_are_the_sum_over_all_its_features():
    weights = np.random.default_rng(1).normal(size=(language.BUCKETS, 3))
    words = ["a", "kurz", "ä" * 200 + "bcd" + "e" * 300, "".join(random.Random(2).choices("abcdefgh", k=2 * language.PIECE + 5)), "z"]
    assert [len(language.features(w)) for w in words] == [7 + len(w) for w in words]
    want = [weights[np.array(language.features(w)) & (language.BUCKETS - 1)].sum(0) for w in words]
    assert np.allclose(language.gathered(weights, words), want)
