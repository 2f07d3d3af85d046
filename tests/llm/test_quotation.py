"""Quotation and report against abuse: scores of single sentences."""

from __future__ import annotations

import random

import pytest

from tessera.llm import toxicity

TOLD = [
    'he said "you idiot" to me', "« tu es un idiot »", "«tu es un idiot»", "'idiot' is a word", "The word idiot comes from Greek.", 'she said "you are\nan idiot" again', "he called me an idiot", "an idiot means a fool",
    "Er rief: „du idiot“ und ging.", "he said ‘you moron’ and left", 'she wrote "' + "and so on " * 100 + 'you idiot" that day', "(“stupid”)", "le mot idiot vient du grec", "",
]
SAID = [
    "you idiot", "you are a stupid idiot, get out", "iddiiot, you", "stuuupid you are", "don't be such an idiot, it's stupid", 'you "friend" are an idiot', '"fine" you idiot, not "fine"', "what an idi0t you are, idoit", "i.d.i.o.t you",
    'a 5" pipe, you idiot, and a 6" one', '"open and never closed, you idiot', "said “one.\n\nyou idiot” there",
]


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(2)
    rows = []
    for i in range(400):
        words = rng.choices([f"w{k}x" for k in range(300)], k=60)
        if i % 8 == 0:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(60)] = rng.choice(["idiot", "stupid", "moron", "loser"])
        rows.append((" ".join(words), int(i % 8 == 0)))
    return toxicity.fit(rows)


@pytest.mark.parametrize("text", TOLD)
def test_what_is_told_is_not_abuse(scorer, text):
    assert scorer.score([text])[0][0] < 0.5


@pytest.mark.parametrize("text", SAID)
def test_what_is_said_is(scorer, text):
    assert scorer.score([text])[0][0] >= 0.7


def test_quotations_are_pairs():
    of = lambda t: [t[a:b] for a, b in toxicity.quotations(t)]
    assert of('a "b c" d "e"') == ["b c", "e"]
    assert of("it's 'so' isn't it") == ["so"]
    assert of("« a » “b” „c“ ‘d’") == [" a ", "b", "c", "d"]
    assert of('one " two') == of('"x') == of("don't can't") == of("") == []
    assert len(of("' " * 10_000)) <= 10_000
