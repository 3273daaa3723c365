"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its word count and link density, those of the blocks before
and after it, and what the elements around it say (an article; a menu, a footer, an advert; a name that hints at such). A
decision tree, trained on the blocks of the labelled pages below with Spark ML, tells main text from the rest; the chosen
blocks make up the text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_rest", "hinted", "heading")

_FILLER = "the river had risen in the night and by morning the lower road was under water so the market moved up the hill".split()


def _text(mark: str, words: int) -> str:
    return mark + " ".join(_FILLER[i % len(_FILLER)] for i in range(words))


def _main(*sizes: int, tag: str = "p") -> str:
    """Blocks of main text with so many words each; in the labelled pages these begin with a plus sign."""
    return "".join(f"<{tag}>{_text('+', n)}</{tag}>" for n in sizes)


def _rest(*sizes: int, tag: str = "p") -> str:
    return "".join(f"<{tag}>{_text('-', n)}</{tag}>" for n in sizes)


def _links(*sizes: int, tag: str = "li") -> str:
    return "".join(f"<{tag}><a href='/x'>{_text('-', n)}</a></{tag}>" for n in sizes)


def _partly(mark: str, linked: int, words: int, tag: str = "p") -> str:
    """A block of which some words are a link."""
    return f"<{tag}>{_text(mark, words - linked)} <a href='/y'>{_text('', linked)}</a></{tag}>"


_MENU, _LONG_MENU, _CRUMBS = _links(1, 1, 2, 1, 1), _links(1, 2, 1, 1, 3, 2, 1, 1, 2, 1), _links(1, 2, 4)

#: Labelled pages, on whose blocks the tree is trained. Pages without telling names come first: there words and links decide.
LABELLED_PAGES = (
    # plain boxes: a menu of links, the text, a list of links, a line of small print
    f"<div>{_LONG_MENU}</div><div>{_main(7, tag='h1')}{_main(80, 62, 45, 90)}</div><div>{_links(4, 6, 5, 7)}</div><div>{_partly('-', 4, 6)}</div>",
    f"<ul>{_MENU}</ul>{_main(5, tag='h2')}{_main(120, 33, 14, 70)}{_partly('+', 3, 60)}<ul>{_LONG_MENU}</ul>",
    f"<table><tr>{_links(1, 1, 1, 2, tag='td')}</tr></table>{_main(9, tag='h1')}{_main(44, 12, 8, 52)}{_main(6, 9, 4, 11, tag='li')}{_main(30)}<table><tr>{_links(2, 3, 1, tag='td')}</tr></table>",
    f"<div>{_CRUMBS}</div><div>{_main(25, 18, 140)}{_partly('+', 2, 28)}{_main(65)}</div><div>{_links(5, 5, 6, 4, 8, 3)}</div><div>{_partly('-', 5, 7)}{_links(2, 2, 1)}</div>",
    f"<div>{_LONG_MENU}</div><div>{_main(6, tag='h1')}{_main(16, 22, 31, 27, 19, 40)}</div><div>{_partly('-', 20, 24)}{_partly('-', 11, 14)}{_links(9, 7, 12)}</div>",
    f"<div>{_links(3, 4)}</div>{_main(200, 90, 85)}<div>{_links(6, 6, 6)}{_MENU}</div>",
    f"<div>{_MENU}{_LONG_MENU}</div>{_main(4, tag='h1')}{_main(37)}{_main(5, tag='h3')}{_main(58)}{_main(3, tag='h3')}{_main(49)}<div>{_CRUMBS}{_MENU}</div>",
    # an article between the parts of a site
    f"<header>{_rest(3, tag='h2')}</header><nav><ul>{_LONG_MENU}</ul></nav><article>{_main(8, tag='h1')}{_main(60, 3, 45, 1, 150, 2)}</article><footer>{_rest(6)}</footer>",
    f"<nav>{_MENU}</nav><div class='ad'>{_rest(8)}</div><article>{_main(11, tag='h1')}{_main(1, 30, 2, 9)}<div class='ad'>{_rest(7)}</div>{_main(12, 55, 5)}</article><footer>{_rest(4)}</footer>",
    f"<nav>{_MENU}</nav><main>{_main(6, tag='h1')}{_links(4, 20, 2).replace('-', '+')}{_main(28, 14)}{_partly('+', 4, 12)}{_partly('+', 12, 18)}</main><aside>{_rest(5, 60, 18)}{_links(3, 3)}</aside>",
    f"<div class='ads'>{_rest(22, 9)}</div><article>{_main(5, tag='h1')}{_main(4, 8, 230)}{_main(6, 2, 7, tag='li')}<aside>{_rest(3, tag='h3')}{_rest(44)}</aside>{_main(33, 1)}</article><form>{_rest(2, 4)}</form>",
    f"<nav>{_CRUMBS}</nav><article>{_main(14, tag='h1')}{_main(40, 6, 7)}<div class='promo'>{_rest(30, 12)}</div>{_main(18, 10)}</article><div class='comments'>{_rest(4, tag='h3')}{_rest(75, 16, 140, 9)}</div>",
    f"<article>{_main(3, tag='h1')}{_main(9, 5)}</article><div class='comment'>{_rest(110, 25)}</div><footer>{_partly('-', 3, 12)}{_rest(30)}</footer>",
    # compound names that only hint: notices that stand alone, and wrappers of whole pages
    f"<div class='cookie-notice'>{_rest(24)}</div><div>{_LONG_MENU}</div><div>{_main(7, tag='h1')}{_main(70, 48, 55)}</div><div class='newsletter-signup'>{_rest(5, tag='h3')}{_rest(16)}</div>",
    f"<nav>{_MENU}</nav><div class='cookie-notice'>{_rest(4)}</div><article>{_main(6, tag='h1')}{_main(30, 12)}</article><ul>{_MENU}</ul><div class='page-footer'>{_rest(11)}</div>",
    f"<ul>{_CRUMBS}</ul><div class='sponsored-box'>{_rest(17)}</div>{_main(60, 44)}<ul>{_MENU}</ul><div class='popup-inner'>{_rest(22, 2)}</div>",
    f"<div class='top-banner'>{_rest(12)}</div>{_MENU}<article>{_main(50, 20, 66)}</article><div class='ad-slot'>{_rest(9)}</div><div class='site-footer'>{_rest(8)}{_links(1, 1)}</div>",
    f"<div class='search-history'><ul>{_MENU}</ul>{_main(6, tag='h1')}{_main(60, 35, 90, 41, 26)}{_links(5, 5)}</div>",
    f"<div class='menu-recipes'>{_links(2, 2, 2)}{_main(90, 75, 64, 58)}</div><div class='share-bar'>{_rest(3)}{_links(1, 1, 1)}</div>",
    f"<div class='comment-list'>{_rest(20, 14, 9)}</div><div class='related-posts'>{_rest(2, tag='h4')}{_links(8, 7, 9)}</div>{_main(45, 80, 39)}",
)

_DROPPED = "script|style|noscript|template|svg|iframe|object|canvas|textarea|select|button"
_MARK = re.compile(r"<(?:(?P<comment>!--)|(?P<data>!\[CDATA\[)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))", re.I)
_DROPPED_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _DROPPED.split("|")}
#: Tags that may close themselves; a slash before the end of any other tag that is dropped means nothing.
_FOREIGN = frozenset({"svg"})
_TURN = re.compile("[>\"']")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav"
    " ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_KEPT_OPEN = _BLOCKS - {"p", "hr", "html", "body"}
_MAIN = frozenset({"article", "main"})
_REST = frozenset({"nav", "footer", "header", "aside", "form", "head", "menu", "dialog", "fieldset", "title"})
_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_REST_NAMES = frozenset(
    "ad ads advert adverts advertisement adverbox banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr"
    " header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion related reply replies respond search share sharing"
    " sidebar sidebars signup skip social sponsor sponsored subscribe subscription tagcloud toolbar widget widgets".split()
)
_MAIN_NAMES = frozenset("articlebody".split())


_NOT = frozenset("has have is no not with without hide".split())


def _named(rest: str) -> tuple[bool, bool, bool]:
    """If an element's names say that it holds main text, or something else, or only hint at that: a whole name says it, a part of
    a compound name hints, but for those that tell what an element has or lacks (``has-sidebar``)."""
    names = [w for value in _NAMED.findall(rest) for w in value.strip("\"'").lower().split()]
    parts = [[x for x in re.split(r"[^a-z0-9]+", w) if x] for w in names]
    hint = any(len(p) > 1 and p[0] not in _NOT and not _REST_NAMES.isdisjoint(p) for p in parts)
    return any(w in _MAIN_NAMES for w in names), any(w in _REST_NAMES for w in names), hint


class _Ends:
    """Where tags end: at the first ``>`` outside quotes. What was found is remembered, so a page is read about once however
    its quotes are broken; a tag that never ends is text."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.known: dict[int, int] = {}
        self.near = (0, -1)  # from here on, the next of > " ' is there
        self.last = page.rfind(">")

    def _turn(self, at: int) -> int:
        if not self.near[0] <= at <= self.near[1]:
            hit = _TURN.search(self.page, at)
            self.near = (at, hit.start() if hit else len(self.page))
        return self.near[1]

    def of(self, at: int) -> int:
        """The place after the end of the tag that goes on at ``at``; -1 if it doesn't end."""
        passed, end = [], -1
        while at <= self.last:
            turn = self._turn(at)
            if turn in self.known:
                end = self.known[turn]
                break
            passed.append(turn)
            if turn >= len(self.page):
                break
            if self.page[turn] == ">":
                end = turn + 1
                break
            close = self.page.find(self.page[turn], turn + 1)
            if close < 0:
                break
            at = close + 1
        self.known.update(dict.fromkeys(passed, end))
        return end


def pieces(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, is an end tag, attributes) of each piece of markup in turn; tag is None where it is to be skipped:
    comments, declarations, and elements that are dropped with what they hold. One that isn't closed goes to the page's end."""
    ends, at = _Ends(page), 0
    unclosed: set[str] = set()
    while (mark := _MARK.search(page, at)) is not None:
        start, tag = mark.start(), None
        at = mark.end()
        if mark["comment"] or mark["data"]:
            stop = "-->" if mark["comment"] else "]]>"
            empty = next((len(x) for x in (">", "->") if mark["comment"] and page.startswith(x, at)), 0)
            close = at if empty else -1 if stop in unclosed else page.find(stop, at)
            if close < 0:
                unclosed.add(stop)
            at = len(page) if close < 0 else close + (empty or len(stop))
        elif mark["other"]:
            close = page.find(">", at) if at <= ends.last else -1
            if close < 0:
                continue
            at = close + 1
        else:
            close = ends.of(at)
            if close < 0:
                at = start + 1
                continue
            rest, tag, at = page[at : close - 1], mark["tag"].lower(), close
            if tag in _DROPPED_END and not mark["end"] and not (tag in _FOREIGN and rest.endswith("/")):
                shut = None if tag in unclosed else _DROPPED_END[tag].search(page, at)
                if shut is None:
                    unclosed.add(tag)
                stop = ends.of(shut.end()) if shut else -1
                at, tag = stop if stop >= 0 else len(page), None
            else:
                yield start, at, tag, bool(mark["end"]), rest
                continue
        yield start, at, tag, False, ""


class _Open:
    """The open elements around a place, with counts, so that a block or an end tag costs no walk through all of them. What is
    opened within a main element starts without hints from outside it."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, bool, bool, bool]] = []
        self.of_tag: dict[str, int] = {}
        self.main = self.rest = 0
        self.hints = [0]  # since each open main element

    def push(self, tag: str, main: bool, rest: bool, hint: bool) -> None:
        self.tags.append((tag, main, rest, hint))
        self.of_tag[tag] = self.of_tag.get(tag, 0) + 1
        self.main += main
        self.rest += rest
        if main:
            self.hints.append(0)
        self.hints[-1] += hint

    def pop(self) -> str:
        tag, main, rest, hint = self.tags.pop()
        self.of_tag[tag] -= 1
        self.main -= main
        self.rest -= rest
        self.hints[-1] -= hint
        if main:
            self.hints.pop()
        return tag

    def close(self, tag: str) -> None:
        if self.of_tag.get(tag):
            while self.pop() != tag:
                pass

    def flags(self) -> tuple[int, int, int]:
        return int(self.main > 0), int(self.rest > 0), int(self.hints[-1] > 0)


def blocks(page: str | None) -> list[tuple[str, tuple[float, ...]]]:
    """The flat text blocks of a page with their features, in page order; null counts as empty."""
    page = page or ""
    found: list[tuple[str, int, int, int, int, int, int]] = []
    texts: list[str] = []
    linked = anchors = heading = 0
    around = _Open()

    def close_block() -> None:
        nonlocal linked
        words = "".join(texts).split()
        if words:
            found.append((" ".join(words), len(words), min(linked, len(words)), *around.flags(), heading))
        texts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            texts.append(text)
            if anchors:
                linked += len(text.split())

    at = 0
    for start, end, tag, shuts, rest in pieces(page):
        add(page[at:start])
        at = end
        if tag is None:
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if shuts else anchors + 1
        elif tag == "br":
            texts.append("\n")
        elif tag in _BLOCKS:
            close_block()
            heading = int(tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not shuts)
            if tag == "body":
                anchors, around = 0, _Open()
            elif tag in _KEPT_OPEN:
                if shuts:
                    around.close(tag)
                else:
                    anchors = 0
                    main, aside, hint = _named(rest) if rest else (False, False, False)
                    if not rest.endswith("/"):
                        around.push(tag, main or tag in _MAIN, aside or tag in _REST, hint)
    add(page[at:])
    close_block()
    out = []
    for k, (text, words, links, *flags) in enumerate(found):
        before, after = found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None
        near = [x for b in (before, after) for x in ((float(b[1]), b[2] / b[1]) if b else (0.0, 0.0))]
        out.append((text, (float(words), links / words, *near, *map(float, flags))))
    return out


Tree = tuple | float


def labelled_blocks(pages: tuple[str, ...] = LABELLED_PAGES) -> list[tuple[float, ...]]:
    """The features of the blocks of labelled pages, then 1 for main text."""
    return [(*features, float(text[0] == "+")) for page in pages for text, features in blocks(page)]


def train(spark: SparkSession, rows: list[tuple[float, ...]] | None = None) -> Tree:
    """A decision tree on labelled blocks, as nested (feature, bound, at most, above); a leaf is 1.0 for main text."""
    size = len(FEATURES)
    frame = spark.createDataFrame([([float(x) for x in r[:size]], float(r[size])) for r in rows or labelled_blocks()], "x array<double>, label double").coalesce(1)
    model = DecisionTreeClassifier(featuresCol="v", labelCol="label", maxDepth=6, maxBins=64, seed=1).fit(frame.select(array_to_vector("x").alias("v"), "label"))

    def nested(node) -> Tree:
        if node.numDescendants() == 0:
            return float(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild())

    return nested(model._call_java("rootNode"))


def is_main(tree: Tree, features: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree: Tree) -> str:
    """The main blocks of a page, joined by newlines."""
    return "\n".join([text for text, features in blocks(page) if is_main(tree, features)])


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, its length in code points.

    Whole pages are read. Null or empty html, and pages without main text, give an empty text. Repeated rows are each
    extracted; an empty table gives an empty result; other columns pass through, those named as a result column are
    replaced.
    """
    tree = tree or train(pages.sparkSession)

    @F.pandas_udf(T.StringType())
    def text_of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return pages.drop("text", "n_chars").withColumn("text", text_of("html")).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
