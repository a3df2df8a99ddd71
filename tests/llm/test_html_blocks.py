"""What a page hides and what it does not."""

import time

import pytest

from sparkclean.llm import html_text


def texts(page):
    return [text for text, *_ in html_text.leaf_blocks(page)]


@pytest.mark.parametrize("shown", ['class="post overflow-hidden"', 'style="overflow:hidden"', 'data-hidden-ads="1"', "data-x='is hidden'", 'title="display:none"', 'aria-hidden="false"', "class=hidden-xs", 'data-aria-hidden="true"', 'style="--display:none"'])
def test_wrappers_that_only_speak_of_hiding(shown):
    assert texts(f"<body><article {shown}><p>One.</p><p>Two.</p></article></body>") == ["One.", "Two."]


@pytest.mark.parametrize("hiding", ["hidden", 'class="a" hidden', 'hidden=""', "HIDDEN=hidden", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"', "style='display:none!important'"])
def test_hidden_wrappers(hiding):
    assert texts(f"<body><div {hiding}><p>One.</p></div><p>Two.</p></body>") == ["Two."]


@pytest.mark.parametrize("begin", ["<body>", "<body class=x>", "", "<div>", "<link href=/s>\n<main>"])
def test_head_without_its_end(begin):
    assert texts(f"<html><head><title>T</title><meta charset=utf-8>{begin}<p>One.</p><p>Two.</p></html>") == ["One.", "Two."]


def test_text_and_a_second_head():
    assert texts("<head><title>A <b>c</title>\n One.<p>Two.</p>") == ["One.", "Two."]
    assert texts("<head><title>T</title><head></head><body><p>One.</p>") == ["One."]
    assert texts("<html><head><title>T</title></head><body><p>One.</p></body></html>") == ["One."]
    assert texts("<head><title>T</title>Last") == ["Last"]


@pytest.mark.parametrize("letters", ["a", "é"])
def test_digits_of_a_whole_block_count(letters):
    few, late, early = (html_text.block_features([(t, frozenset(), 0)])[0] for t in (letters * 1000, letters * 900 + "1" * 100, "1" * 100 + letters * 900))
    assert (late == early).all() and [(a, b) for a, b in zip(few, late) if a != b] == [(0, 0.4)]


@pytest.mark.parametrize("unit", ["<a href='", '<a "', "<a '>'", "<a<a", "<!", "</", "<a \"'>", "<", "<a b='>\"", "<!--", "<script "])
def test_markup_left_open_takes_no_longer(unit):
    """A megabyte of it; a tokenizer that starts over at each tag takes an hour."""
    began = time.perf_counter()
    html_text.leaf_blocks(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(("opened", "met"), [("<b>", "</i>"), ("<b>", "<hr>"), ("<b>", "<li></li>"), ("<b>", "<head>"), ("<table><i>", "<tr><td>"), ("<div>", "</b>")])
def test_deep_pages_take_no_longer(opened, met):
    began = time.perf_counter()
    html_text.leaf_blocks("<b>" + opened * 50_000 + met * 50_000 + "x")
    assert time.perf_counter() - began < 10


def test_tokens_at_open_quotes():
    shown = lambda page: [(page[a:b], tag) for a, b, _, tag, _ in html_text.tokens(page)]
    assert shown("<a title='x>y'>t</a>") == [("<a title='x>y'>", "a"), ("</a>", "a")]
    assert shown("<a title='x>y<b>t</b>") == [("<a title='x>", "a"), ("<b>", "b"), ("</b>", "b")]
    assert shown("1 < 2 <!x> <a") == [("<!x>", "")]


def test_formulas_are_text():
    assert texts("<body><p>For <math><mi>x</mi><mo>=</mo><mn>2</mn></math> it holds.</p>") == ["For x=2 it holds."]
