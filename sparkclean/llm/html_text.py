"""Main text of web pages: a conditional random field labels DOM leaf blocks, and Viterbi decoding picks the article.

Blocks carry features of their ancestor tags and class names and of their text. The chain is trained on labelled
pages, which `labelled_pages` lays out from page plans in many styles, and applied to whole pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf

#: Labelled pages that the chain is trained on.
TRAINING_PAGES = 500

#: Tags that end a block, that hold no text, and whose content is no text: fixed values of the HTML standard.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head title textarea select button object canvas svg audio video".split())
#: Tags that leave an open head open; any other starts the body.
_IN_HEAD = set("base basefont bgsound head html link meta noframes title".split())
_CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption option legend summary".split())
_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: Comments and raw text, which end with the page at the latest, and tags without ``<`` or ``>`` in their values.
_PLAIN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|iframe)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>\"']*)(?P<rest>(?>[^'\"<>]|\"[^\"<>]*\"|'[^'<>]*')*+)>",
    re.S | re.I,
)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile(r"[\"'>]")
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_BLANKS = re.compile(r"\s+")

#: Words in class names and ids, by what they tell: fixed values.
HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs pagination pager toc sitemap skip",
    "head": "header masthead topbar top logo branding banner",
    "foot": "footer foot copyright legal bottom colophon",
    "side": "sidebar aside side rail widget widgets related recommended recommendations popular trending more teaser promo complementary",
    "ad": "ad ads adv advert advertisement sponsor sponsored promotion promoted adslot adsense dfp",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe paywall warning message disclaimer dialog toast",
    "comment": "comment comments commentary discussion reply replies respond disqus thread feedback review reviews",
    "share": "share sharing social follow like tools actions toolbar",
    "form": "form search login signin signup register contact input poll survey",
    "text": "article content post entry story text body main articlebody maincontent prose",
}
_GROUP = {word: group for group, words in HINTS.items() for word in words.split()}
_TAGS = ["nav", "header", "footer", "aside", "article", "main", "section", "form", "li", "table", "figure", "blockquote", "h1", "h2", "h3", "p", "dialog", "menu"]
_PLACE = {name: k for k, name in enumerate([*_TAGS, *[f"~{g}" for g in HINTS]])}
WIDTH = len(_PLACE) + 14


@lru_cache(maxsize=50_000)
def _marks(tag: str, attributes: str) -> frozenset[int]:
    found = {_PLACE[tag]} if tag in _PLACE else set()
    for m in _NAMED.finditer(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
            if word in _GROUP:
                found.add(_PLACE[f"~{_GROUP[word]}"])
    return frozenset(found)


@lru_cache(maxsize=50_000)
def _hides(attributes: str) -> bool:
    """Whether a tag with these attributes is not shown."""
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in seen:  # of repeated attributes the first one counts
            continue
        seen.add(name)
        if name == "hidden" and not value.lower().startswith(("false", "until")) or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``(begin, end, closing, tag, attributes)`` of the markup of a page; other markup than tags has no tag.

    A ``>`` inside quotes does not end a tag, unless the quotes or the tag would never end. Where each quote leads is
    remembered, so a page takes time in proportion to its length whatever is left open in it.
    """
    last_end, leads = page.rfind(">"), {}

    def tag_end(at: int) -> int:
        """The first ``>`` from ``at`` on that is in no quotes, or -1."""
        found, met = -1, []
        while m := _SPECIAL.search(page, at):
            if m[0] == ">":
                found = m.start()
                break
            if m.start() in leads:
                found = leads[m.start()]
                break
            met.append(m.start())
            close = page.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        leads.update(dict.fromkeys(met, found))
        return found

    at = page.find("<")
    while at >= 0:
        stop = at + 1
        if m := _PLAIN.match(page, at):
            stop = m.end()
            yield at, stop, bool(m["end"]), (m["tag"] or "").lower(), m["rest"] or ""
        elif at < last_end and (m := _OPEN.match(page, at)):
            end = tag_end(m.end())
            end = page.find(">", m.end()) if end < 0 else end
            stop = end + 1
            yield at, stop, bool(m[1]), m[2].lower(), page[m.end() : end]
        elif at < last_end and page[at + 1] in "!?/":
            stop = page.find(">", at) + 1
            yield at, stop, False, "", ""
        at = page.find("<", stop)


def leaf_blocks(page: str) -> list[tuple[str, frozenset[int], int]]:
    """``(text, ancestor marks, characters in links)`` of each leaf block in page order; blank blocks are left out."""
    stack: list[tuple[str, frozenset[int], bool]] = []  # tag, marks of it and all above, hidden
    out, parts, linked = [], [], 0
    links = 0
    nothing: frozenset[int] = frozenset()

    def close_block() -> None:
        nonlocal parts, linked
        if parts:
            text = _BLANKS.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, stack[-1][1] if stack else nothing, min(linked, len(text))))
            parts, linked = [], 0

    where: dict[str, list[int]] = {"": []}  # places in the stack by tag, under no tag those of blocks

    def last_of(*tags: str) -> int:
        """The highest place of any of these tags, or -1: found without going through the stack."""
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def pop_to(k: int) -> None:
        nonlocal links
        for tag, *_ in stack[k:]:
            links -= tag == "a"
            where[tag].pop()
            if tag in BLOCK:
                where[""].pop()
        del stack[k:]

    def in_head() -> bool:
        return bool(stack) and stack[-1][0] == "head"

    last = 0
    for begin, end, closing, tag, attributes in tokens(page):
        if begin > last and in_head() and not page[last:begin].isspace():
            pop_to(len(stack) - 1)
        if begin > last and not (stack and stack[-1][2]):
            text = html.unescape(page[last:begin])
            parts.append(text)
            linked += len(text) if links > 0 else 0
        last = end
        if not tag:
            continue
        if closing:
            if in_head() and tag in ("body", "html", "br"):
                pop_to(len(stack) - 1)
            if tag in BLOCK:
                close_block()
            at = last_of(tag)
            if at >= 0 and (tag in BLOCK or last_of("") < at):
                pop_to(at)
            continue
        if tag == "head" and len(stack) > len(where.get("html", [])):
            continue
        if in_head() and tag not in _IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in BLOCK or tag in HIDDEN:
            close_block()
            if tag in _CLOSES_P:
                at = last_of("")
                if at >= 0 and stack[at][0] == "p":
                    pop_to(at)
            if tag in _SAME:
                at = last_of(*next((pair for pair in (("dt", "dd"), ("td", "th")) if tag in pair), (tag,)))
                if at > last_of(*_SAME[tag]):
                    pop_to(at)
        if tag == "br":
            parts.append("\n")
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path", "g"):
            continue
        above = stack[-1] if stack else ("", nothing, False)
        stack.append((tag, above[1] | _marks(tag, attributes), above[2] or tag in HIDDEN or bool(attributes) and _hides(attributes)))
        where.setdefault(tag, []).append(len(stack) - 1)
        if tag in BLOCK:
            where[""].append(len(stack) - 1)
        links += tag == "a"
    if last < len(page) and in_head() and not page[last:].isspace():
        pop_to(len(stack) - 1)
    if last < len(page) and not (stack and stack[-1][2]):
        parts.append(html.unescape(page[last:]))
    close_block()
    return out


def block_features(blocks: list[tuple[str, frozenset[int], int]]) -> np.ndarray:
    """A row of features for each block."""
    out = np.zeros((len(blocks), WIDTH))
    base = len(_PLACE)
    for k, (text, marks, linked) in enumerate(blocks):
        out[k, list(marks)] = 1
        n, words = len(text), text.count(" ") + 1
        share = linked / n
        digits = sum(map(text.count, "0123456789")) if text.isascii() else sum(map(str.isdigit, text))
        out[k, base:] = (
            1, min(math.log1p(words), 6) / 3, words < 4, words < 10, words > 25, share, share > 0.6, text[-1] in ".!?…\"”»。", "©" in text or "all rights" in text.lower(),
            min(1, sum(map(text.count, ",;")) / words * 5), min(1, digits / n * 4), text.isupper() and n > 3, k == 0, k == len(blocks) - 1,
        )
    return out


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """``n`` pages in invented words and many styles, with the label of each leaf block: 1 for the article."""
    rng = random.Random(seed)
    syllables = "an ar be co da de do el en er fi ga he in is ka la li lo ma me mi na ne no on or pa pe ra re ri ro sa se so ta te ti to un ve vi".split()
    one = lambda *options: rng.choice(options)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(rng.choice((1, 3, 5)), 22).capitalize() + one(".", ".", ".", "!", "?") for _ in range(rng.randint(a, b)))

    def attributes(*names: str) -> str:
        name = rng.choice(names)
        return one("", f' class="{name}"', f' id="{name}"', f' class="{one("c1", "x-", "block ")} {name}"', f' class="{name}"')

    def junk_texts(links: bool, a: int, b: int) -> tuple[list[str], list[int]]:
        texts = [words(1, 4) if links or rng.random() < 0.5 else sentences(1, 2) for _ in range(rng.randint(a, b))]
        return [f'<a href="/{k}">{t}</a>' if links else t for k, t in enumerate(texts)], [0] * len(texts)

    def listed(tag: str, attribute: str, items: list[str]) -> str:
        inner = one("ul", "ol", "div")
        item = "li" if inner != "div" else "div"
        return f"<{tag}{attribute}><{inner}>" + "".join(f"<{item}>{i}</{item}>" for i in items) + f"</{inner}></{tag}>"

    def part(kind: str) -> tuple[str, list[int]]:
        if kind == "menu":
            items, labels = junk_texts(True, 3, 9)
            return listed(one("nav", "nav", "div"), attributes("nav", "menu", "navbar", "breadcrumb"), items), labels
        if kind == "header":
            return f"<{(t := one('header', 'header', 'div'))}{' class=header' if t == 'div' else ''}><p>{words(1, 5)}</p></{t}>", [0]
        if kind == "footer":
            tag = one("footer", "footer", "footer", "div")
            mark = attributes("footer", "legal") if tag == "footer" else f' class="{one("footer", "site-footer", "copyright")}"'
            return f"<{tag}{mark}>{one('&copy; ', '&#169; 2020 ', '')}{one(words(2, 6), sentences(1, 2))}{one('', ' All rights reserved.')}</{tag}>", [0]
        if kind in ("side", "ad", "notice", "share"):
            name = one(*HINTS[kind].split())
            tag = one("aside", "div", "section") if kind == "side" else one("div", "div", "section", "aside" if kind == "ad" else "dialog" if kind == "notice" else "div")
            if tag == "div" or tag == "section":
                mark = one(f' class="{name}"', f' id="{name}"', f' class="{one("site", "page", "inner")}-{name}"')
            else:
                mark = attributes(name)
            if kind == "share" or kind == "side" and rng.random() < 0.6:
                items, labels = junk_texts(True, 2, 6)
                return listed(tag, mark, items), labels
            if rng.random() < 0.6:
                return f"<{tag}{mark}>{sentences(1, 3)}</{tag}>", [0]
            k = rng.randint(1, 3)
            return f"<{tag}{mark}>" + "".join(f"<p>{sentences(1, 3)}</p>" for _ in range(k)) + f"</{tag}>", [0] * k
        if kind == "form":
            return f"<form><label>{words(1, 3)}</label><input name=q><p>{words(1, 8)}</p><button>{words(1, 2)}</button></form>", [0, 0]
        k = rng.randint(1, 6)
        name = one("comments", "comment-list", "discussion", "replies", "responses comments")
        inner = "".join(f"<{(t := one('div', 'li', 'article'))} class=\"{one('comment', 'reply')}\"><p>{sentences(1, 4)}</p></{t}>" for _ in range(k))
        return f'<{(t := one("section", "div"))} {one("id", "class")}="{name}"><h3>{words(1, 2)}</h3>{inner}</{t}>', [0] * (k + 1)

    for _ in range(n):
        body, labels = "", []

        def add(piece: tuple[str, list[int]]) -> None:
            nonlocal body, labels
            body, labels = body + piece[0] + one("", "\n", "<!-- x -->"), labels + piece[1]

        for kind in ("header", "menu", "notice", "ad"):
            if rng.random() < 0.6:
                add(part(kind))
        around = one("main", "div", "")
        body += f"<{around}{attributes('main', 'container', 'page')}>" if around else ""
        tag = one("article", "article", "article", "div", "main", "section")
        mark = attributes("post", "story", "entry") if tag in ("article", "main") else f' class="{one("content", "article-body", "post-content", "story", "entry-content", "main-text")}"'
        body += f"<{tag}{mark}>"
        if rng.random() < 0.8:
            add((f"<{(h := one('h1', 'h1', 'h2'))}>{words(2, 10)}</{h}>", [1]))
        for k in range(rng.randint(1, 14)):
            style = rng.random()
            if style < 0.7:
                text = one(sentences(1, 8), sentences(2, 8), sentences(1, 1), words(1, 3).capitalize() + ".", one(words(1, 6).upper() + "!!", "All rights reserved.", words(3, 20).replace(" ", "%%% "), words(5, 15)))
                add((f"<p>{one('', '', '<b>', '<i>')}{text}{one('', '</p>', '</p>')}", [1]))
            elif style < 0.78:
                add((f"<h{(h := rng.randint(2, 3))}>{words(1, 7)}</h{h}>", [1]))
            elif style < 0.85:
                m = rng.randint(2, 5)
                add(("<ul>" + "".join(f"<li>{one(words(2, 12), sentences(1, 2))}</li>" for _ in range(m)) + "</ul>", [1] * m))
            elif style < 0.9:
                add((f"<blockquote>{sentences(1, 4)}</blockquote>", [1]))
            elif style < 0.94:
                add((f"<p>{words(1, 8)}.<br>{words(1, 8)}.</p>", [1]))
            elif k:
                add(part(one("ad", "side", "share", "notice", "form")))
        body += f"</{tag}>"
        for kind in ("share", "comment", "side", "ad"):
            if rng.random() < 0.4:
                add(part(kind))
        body += f"</{around}>" if around else ""
        for kind in ("side", "form", "notice", "menu", "footer"):
            if rng.random() < (0.8 if kind == "footer" else 0.35):
                add(part(kind))
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}<script>var a='<p>x</p>'</script></body></html>", labels


@lru_cache(maxsize=4)
def trained(n: int = TRAINING_PAGES, seed: int = 11) -> crf.Crf:
    """The chain, trained on ``n`` labelled pages."""
    sequences = []
    for page, labels in labelled_pages(n, seed):
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        sequences.append((block_features(blocks), np.array(labels)))
    return crf.fit(sequences, rounds=200)


def main_text(page: str | None, model: crf.Crf) -> str:
    """The blocks that the chain labels as article, one to a line."""
    blocks = leaf_blocks(page or "")
    marks = model.decode(model.scores(block_features(blocks))) if blocks else []
    return "\n".join(text for (text, *_), m in zip(blocks, marks) if m)


def extract(pages: DataFrame, model: crf.Crf | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    A null or empty page, or one without an article, has the empty text. Repeated rows and null ids come out as they
    are; other columns are ignored; an empty table gives an empty result.
    """
    model = model or trained()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, model) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
