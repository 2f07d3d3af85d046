"""Features of words are of letters, not of the bytes that spell them."""

from __future__ import annotations

from zlib import crc32

from tessera.llm import language


def brute(word: str) -> list[int]:
    edged = f"<{word}>"
    ends = [crc32(x.encode(), seed) for n in (2, 3, 4) for x, seed in ((edged[:n], 2), (edged[-n:], 3))]
    return [crc32(word.encode(), 1), *ends, *(crc32(edged[i : i + 3].encode(), 4) for i in range(len(edged) - 2))]


def test_features_are_all_letter_trigrams():
    words = ["a", "kurz", "größe", "ä" * 200 + "bcd" + "e" * 300, "漢字かな", "x" * (language.PIECE + 9), "ß" * (language.PIECE + 9)]
    for w in words:
        assert language.features(w) == brute(w)
        assert len(language.features(w)) == 7 + len(w)
