"""Very large and broken pages take time in proportion to their size."""

import time

import pytest

from tablekeep.llm import html

N = 100_000
ARTICLE = "<article><p>" + "some words of the article " * 20 + "</p></article>"
PAGES = {
    "unclosed tag with quoted values": ARTICLE + "<a " + ' data-a="foo bar"' * 10_000,
    "unclosed tag before another": ARTICLE + "<a " + '""' * 10_000 + "<p>x",
    "apostrophes": ARTICLE + "<b '" * 10_000,
    "nested blocks": "<div>" * N + ARTICLE,
    "nested blocks with text and marked names": "<div class='has-sidebar'>" + "<div>a b" * N,
    "nested inline elements": ARTICLE + "<b>x" * N,
    "unmatched end tags": ARTICLE + "<div>" * (N // 2) + "</p></span></li>" * (N // 2),
    "one long text": "<article><p>" + "word " * N * 4 + "</p></article>",
}


@pytest.mark.parametrize("name", PAGES)
def test_time_in_proportion(name):
    start = time.perf_counter()
    text = html.main_text(PAGES[name])
    assert time.perf_counter() - start < 4  # about half a second; hours before
    assert ("words of the article" in text or "text" in name or "nested blocks" in name)


def test_quotes_in_tags():
    page = "<article><p title=\"a > b\" class='x>y'>one</p><p title='it\"s'>two</p><p title=\"open>three</p></article>"
    assert html.main_text(page) == "one\ntwo\nthree"
    assert html.main_text("<article><p>one</p><p a='b' c=\"d<p>two</p></article>") == "one\ntwo"
