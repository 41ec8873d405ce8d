"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. Each block is described by its own word count and
link density, those of its neighbours, and by marks: whether it lies in an article; how many
containers marked as boilerplate (by tag, or by a name of its class, id or role) lie between it and
that article; and how many more lie around it than around the page's own text. A mark alone decides
nothing: what surrounds the whole text (a form, a class such as ``story-promo``) has no excess.
A CART tree decides which blocks are main text. Its labelled table is a few hundred pages that
``labelled_pages`` makes from a seed, with and without articles and marks, with wrappers, link-rich
paragraphs, unmarked menus and notices, and comments.

Defined results: a null or empty html, or one without main text, gives an empty text; a page that
breaks off is read as far as it goes; repeated rows are handled one by one; null page_ids and urls
are carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements whose content is never text of the page.
SKIPPED = "script|style|title|template|noscript|textarea|select|button|iframe|svg|object|canvas|math"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id or role that mark boilerplate.
BOILER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer header masthead topbar toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations popular trending newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices alert popup modal overlay search form copyright legal disclaimer pagination pager tags taglist skip contentinfo complementary outbrain taboola".split())
#: Words that leave a compound such as ``related-posts`` boilerplate; others (``popular-science``, ``nav-open``) do not.
NEUTRAL_WORDS = frozenset("area article articles bar block body bottom box button buttons col column container content entry global group holder icon icons inner item items label left link links list main module outer page panel post posts primary region right row secondary section site slot story text title top unit wrap wrapper zone".split())
#: Blocks that hold text and whose end tag may be left out.
LEAVES = frozenset("p li dt dd option td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article story post entry articlebody main content".split())

_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: A block that starts like a legal notice.
_NOTICE = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)
#: The words of main text in the labelled table.
_MAIN = re.compile(r"\bm\d")
#: Of the page's words, what makes a level of marks one of its own text.
FAIR_SHARE = 0.15
#: The labelled table: its seed and its number of pages.
TABLE_SEED, TABLE_PAGES = 1, 600


def marked(names: list[str]) -> bool:
    """Whether a name of a class, id or role marks boilerplate: it has such a word, and only neutral ones beside it."""
    for name in names:
        words = set(_WORD.findall(name))
        if words & BOILER_WORDS and all(w in BOILER_WORDS or w in NEUTRAL_WORDS or len(w) == 1 for w in words):
            return True
    return False


class Block:
    __slots__ = ("article", "heading", "inner", "linked", "outer", "text", "words")

    def __init__(self, text: str, words: int, linked: int, inner: int, outer: tuple[int, ...], article: int, heading: bool):
        self.text, self.words, self.linked, self.inner, self.outer, self.article, self.heading = text, words, linked, inner, outer, article, heading


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, without empty ones."""
    out: list[Block] = []
    stack: list[tuple[str, tuple, tuple, int]] = []  # open containers and what held before each: marked containers within the article and around it, articles
    text: list[str] = []
    linked: list[str] = []
    inner: tuple[int, ...] = ()
    outer: tuple[int, ...] = ()
    link = article = 0
    heading = False

    def flush() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, whole.count(" ") + 1, len(entities.unescape(" ".join(linked)).split()), len(inner) if article else 0, outer if article else outer + inner, article, heading))
            text.clear()
            linked.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if link:
                linked.append(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if m[2] else 1
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            link, heading = 0, not m[2] and tag in HEADINGS
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        _, inner, outer, article = stack[k]
                        del stack[k:]
                        break
                continue
            # An open paragraph or cell ends where the next one starts, as its end tag may be left out.
            if tag in LEAVES and stack and stack[-1][0] == tag:
                _, inner, outer, article = stack.pop()
            if tag in LEAVES and not m[4] or tag in VOID:
                continue
            names = [n for x in _MARKS.finditer(m[4]) for n in (x[1] or x[2] or x[3] or "").lower().split()]
            b = tag not in ("main", "html", "body") and (tag in BOILER_TAGS and not (tag == "header" and article) or marked(names))
            a = tag not in LEAVES and not b and (tag in ARTICLE_TAGS or any(w in ARTICLE_WORDS for n in names for w in _WORD.findall(n)))
            if b or tag not in LEAVES:
                stack.append((tag, inner, outer, article))
                inner += (m.start(),) * b
                # The first article, or the page's main part, starts anew; one within another (a comment) does not.
                if a and (not article or tag == "main"):
                    inner, outer = (), outer + inner
                article += a
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def surroundings(blocks: list[Block]) -> tuple[int, ...]:
    """The marked containers around the page's own text: the fewest that hold a fair share of the words of articles, or of all where there are none."""
    words: dict[tuple[int, ...], int] = {}
    for articles in (True, False):
        for b in blocks:
            if bool(b.article) >= articles:
                words[b.outer] = words.get(b.outer, 0) + b.words
        if words:
            break
    fair = [k for k, n in words.items() if n >= FAIR_SHARE * sum(words.values())]
    return min(fair, key=lambda k: (len(k), -words[k]), default=())


def features(blocks: list[Block]) -> list[tuple[float, ...]]:
    """For each block: words and link density of the one before, itself and the one after; marks within the article, excess of marks around it, article, heading, notice, and whether the page has an article."""
    w = [0.0, *(float(b.words) for b in blocks), 0.0]
    d = [0.0, *(min(1.0, b.linked / b.words) for b in blocks), 0.0]
    around, some = surroundings(blocks), float(any(b.article for b in blocks))
    return [(w[k], w[k - 1], w[k + 1], d[k], d[k - 1], d[k + 1], float(b.inner), float(sum(k not in around for k in b.outer)), float(b.article > 0), float(b.heading), float(bool(_NOTICE.match(b.text))), some) for k, b in enumerate(blocks, 1)]


def labelled_pages(seed: int, n: int) -> list[str]:
    """Pages whose blocks of main text have words that start with ``m`` (and no others do)."""
    rng = random.Random(seed)
    pick, name = rng.choice, lambda: rng.choice(("id", "class"))
    words = lambda kind, k: " ".join(f"{kind}{rng.randrange(1000)}" for _ in range(k))

    def linked(kind: str, k: int, share: float) -> str:
        m = round(k * share)
        return f"<a href='/x'>{words(kind, m)}</a> {words(kind, k - m)}" if m else words(kind, k)

    def links(kind: str = "b") -> str:
        return "<ul>" + "".join(f"<li><a href='/x'>{words(kind, rng.randint(1, 4))}</a></li>" for _ in range(pick((1, 1, 2, 3, 4, 6, 8)))) + "</ul>"

    def around(tags: tuple[str, ...], inside: str) -> str:
        tag = pick(tags)
        return f"<{tag}>{inside}</{tag.split()[0]}>"

    def comments() -> str:
        each = [around(("article class='comment'", "div", "article", "li"), f"<p>{words('b', pick((3, 20, 60, 150)))}</p>") for _ in range(rng.randint(1, 4))]
        return around(("div class='comments'", "section id='comments'", "div id='respond'"), "".join(each))

    def paragraph() -> str:
        k = pick((1, 2, 5, 12, 30, 40, 60, 90, 140, 200, 260))
        share = pick((0, 0, 0, 0.05, 0.12, 0.2, 0.35)) if k >= 12 else 0
        return f"<p>{linked('m', k, share)}</p>"

    def text(article: bool) -> str:
        out = [around(("h1", "h2"), words("m", rng.randint(2, 14)))]
        for _ in range(rng.randint(2, 9)):
            out.append(paragraph())
            if article and rng.random() < 0.3:
                out.append(f"<ul><li>{linked('m', rng.randint(1, 9), pick((0, 1)))}</li><li>{words('m', 4)}</li></ul>")
            if article and rng.random() < 0.05:
                out.append(f"<p>Copyright {words('m', 6)}</p>")
            if rng.random() < 0.1:
                out.append(around(("h2", "h3"), words("m", rng.randint(1, 6))))
            if article and rng.random() < 0.12:
                out.append(around(("aside", "div class='share'", "div class='ad'", "form", "div class='related-posts'", "footer", "nav"), pick((links(), f"<p>{words('b', pick((2, 8, 30, 90)))}</p>"))))
        if article and rng.random() < 0.2:
            out.append(comments())
        return "".join(out)

    pages = []
    for _ in range(n):
        article = rng.random() < 0.7
        body = text(article)
        if article:
            body = around(("article", "article", "main", "div class='post-content'", "div id=content", "main><article"), body)
        if rng.random() < 0.25:
            body += comments()
        head = around(("nav", "header", "div class='menu'", "div", "div"), links()) if rng.random() < 0.8 else ""
        if rng.random() < 0.4:
            head += around(("div class='ad'", "aside", "div class='cookie-notice'"), f"<p>{words('b', pick((3, 9, 25, 70)))}</p>")
        foot = pick((f"<footer>{words('b', 9)}</footer>", f"<p>&copy; {words('b', 4)}</p>", f"<div>Copyright {words('b', pick((2, 12)))}</div>", f"<div class='footer'>{links()}<p>{words('b', pick((5, 40)))}</p></div>", links(), f"<form><p>{words('b', 5)}</p></form>", "", "", ""))
        whole = head + body + foot
        for _ in range(pick((0, 0, 0, 1, 1, 2))):
            wrapper = pick(("form", "div {}='story-promo'", "div {}='post-share'", "div {}='content-widget'", "div {}='page-popup'", "div {}='nav-wrapper'", "fieldset")).format(name())
            whole = around((wrapper,), whole) if rng.random() < 0.6 or not article else head + around((wrapper,), body) + foot
        pages.append(f"<html><body>{whole}</body></html>")
    return pages


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 12):
    """A CART tree by Gini impurity, with ``least`` rows or more in each leaf: a leaf's verdict, or (feature, threshold, tree if below or equal, tree if above)."""
    verdict = bool(y.mean() >= 0.5)
    if depth == 0 or y.min() == y.max():
        return verdict
    best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1] - 1, -1, -1):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (at + 1 <= len(y) - least)]
        if not len(at):
            continue
        left, right = ones[at] / n[at], (ones[-1] - ones[at]) / (len(y) - n[at])
        cost = 2 * left * (1 - left) * n[at] + 2 * right * (1 - right) * (len(y) - n[at])
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (float(cost[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] is None:
        return verdict
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


@cache
def train(seed: int = TABLE_SEED, pages: int = TABLE_PAGES):
    """The tree that the labelled table gives."""
    x, y = [], []
    for page in labelled_pages(seed, pages):
        blocks = blocks_of(page)
        x += features(blocks)
        y += [bool(_MAIN.search(b.text)) for b in blocks]
    return grow(np.array(x), np.array(y, float))


def is_main(tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if is_main(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html); a map, without any shuffle."""
    kind, tree = pages.schema["page_id"].dataType.simpleString(), train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), tree) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
