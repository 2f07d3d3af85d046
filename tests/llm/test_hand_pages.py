"""Extraction on pages written by hand, of another make than those it is fitted on."""

from __future__ import annotations

import pytest

from tessera.llm.extraction import FIT_PAGES, BlockCrf
from tessera.llm.labelled_pages import labelled

A = "The council met on Tuesday evening to decide whether the old bridge should be closed. Residents spoke, and most were against it."
B = "The engineer said that the costs would rise each year; a vote was put off until the spring."


@pytest.fixture(scope="module")
def crf():
    return BlockCrf.fit(labelled(FIT_PAGES))


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<html><body><article><p>{A}</p></article></body></html>", A),
        (f"<p>{A}</p>", A),
        (f"<h1>Bridge</h1><p>{A}</p>", f"Bridge\n{A}"),
        (A, A),
        ("<article><p>line one<br>line two</p></article>", "line one line two"),
        (f"<div>{A}</div>", A),
        (f"<main><p>{A}</p><p>{B}</p></main>", f"{A}\n{B}"),
        (f"<body><h1>Bridge</h1>{A}<h2>Costs</h2><p>{B}</p></body>", f"Bridge\n{A}\nCosts\n{B}"),
        (f"<article><p>{A}</p><button>Click</button><p>{B}</p></article>", f"{A}\n{B}"),
        (f"<article><h1>Bridge</h1><p>{A}</p></article><div class='respond'><h3>Replies</h3><div><b>joe</b><p>Nice text, I liked it a lot.</p></div></div>", f"Bridge\n{A}"),
        (f"<nav><a href=/>Home</a> <a href=/b>News</a></nav><article><p>{A}</p><p>{B}</p></article><footer>© 2020 X</footer>", f"{A}\n{B}"),
        ("<nav><ul><li><a href=/>Home</a></li></ul></nav><footer>Copyright 2020</footer>", ""),
        (f"<header><h2>Daily Post</h2></header><main><h1>Bridge</h1><p>{A}</p><form action=/s><label>Search</label><input></form></main><aside class=related><h2>More</h2><p>{B}</p></aside>", f"Bridge\n{A}"),
    ],
)
def test_article_and_nothing_else(crf, html, want):
    assert crf.text(html) == want
