"""Main text of HTML pages.

A page is cut into a flat list of text blocks. Each block is described by its
words and its link density, those of the blocks before and behind it, and the
kind of element around it; a decision tree, trained on a small labelled table
of blocks (``LABELLED``), keeps or drops it.

A NULL, empty or blank page has an empty text. Pages are handled one by one,
whole; unclosed tags, comments and scripts reach to the page's end, as in
browsers. Repeated rows each give a result.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from pairsignals.llm.common import map_texts

#: Elements whose content is no text of the page (fixed values).
SILENT = "script style noscript template svg math title select textarea button iframe object canvas audio video".split()

#: Elements that begin and end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())

#: Elements whose place is remembered while they are open (fixed values).
CONTAINER = frozenset(
    "article main section div nav header footer aside form menu dialog ul ol table figure fieldset blockquote "
    "h1 h2 h3 h4 h5 h6 body".split())
BESIDE = frozenset("nav footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Words of class and id names that stand for other things than the article (fixed values).
HINTS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert newsletter subscribe subscription signup sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended widget popup modal overlay login search form copyright legal "
    "pagination pager tags".split())
MAIN_HINTS = frozenset("article post entry content story main body text".split())

#: Of them, those of other vocabularies than HTML: only they are empty when their tag ends with "/>".
FOREIGN = "svg math".split()

#: Attributes of a tag, to its ">"; quoted values may hold one, unless a quote is never closed.
_REST = r"(?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:" + "|".join(FOREIGN) + r")(?=[\s/>])" + _REST + r"(?<=/)>"
    r"|<(?P<silent>" + "|".join(SILENT) + r")(?=[\s/>]|\Z)" + _REST + r"(?:>.*?(?:</(?P=silent)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>" + _REST + r")(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

FEATURES = ("beside", "hinted", "in main", "heading", "links", "words", "words before", "links before", "words behind",
            "links behind", "ends as sentence")


def hints(rest: str) -> tuple[bool, bool]:
    """Whether names in the attributes hint at other things, or at the article."""
    names = {w for m in _NAMES.findall(rest) for w in re.split(r"[^a-z]+", "".join(m).lower())}
    return bool(names & HINTS), bool(names & MAIN_HINTS)


def blocks(page: str) -> list[tuple]:
    """(text, words, link density, beside, hinted, in main, heading) of each block that has a word."""
    out: list[tuple] = []
    parts: list[str] = []  # of the open block
    linked: list[str] = []  # of them, those inside a link
    open_: list[tuple] = []  # tag, beside, hinted, main, heading
    in_link = False

    def close():
        words = html.unescape("".join(parts)).split()
        if words:
            n = len(html.unescape(" ".join(linked)).split())
            around = [any(x[i] for x in open_) for i in (1, 2, 3, 4)]
            out.append((" ".join(words), len(words), min(1.0, n / len(words)), *around))
        parts.clear()
        linked.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
            if in_link:
                linked.append(parts[-1])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not m["close"]
        if tag not in BLOCK:
            continue
        close()
        in_link = False
        if tag not in CONTAINER:
            continue
        if m["close"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    break
        else:
            hinted, main = hints(m["rest"]) if "=" in m["rest"] else (False, False)
            open_.append((tag, tag in BESIDE or tag == "header" and not any(x[0] == "article" for x in open_), hinted,
                          tag in ("article", "main") or main and not hinted, tag in HEADINGS))
    parts.append(page[at:])
    close()
    return out


def features(found: list[tuple], without: tuple[str, ...] = ()) -> np.ndarray:
    """One row of ``FEATURES`` for each block; those in ``without`` are zero."""
    if not found:
        return np.empty((0, len(FEATURES)))
    own = np.array([b[1:3] for b in found], float)
    edge = np.zeros((1, 2))
    before, behind = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    around = np.array([b[3:7] for b in found], float)
    sentence = np.array([[b[0][-1] in ".!?…:;\"”»"] for b in found], float)
    return np.hstack([around, own[:, ::-1], before, behind, sentence]) * [name not in without for name in FEATURES]


class Tree:
    """A binary decision tree by Gini impurity (CART), grown until leaves are
    pure, ``depth`` is reached, or no split is left."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8):
        self.nodes: list[tuple] = []  # feature, threshold, left, right, answer
        self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, bool(2 * y.sum() >= len(y))))
        best = None
        if depth and 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for t in (values[:-1] + values[1:]) / 2:
                    left = x[:, f] <= t
                    gini = sum(len(s) * s.mean() * (1 - s.mean()) for s in (y[left], y[~left]))
                    if best is None or gini < best[0] - 1e-12:
                        best = (gini, f, t)
        if best:
            _, f, t = best
            left = x[:, f] <= t
            a, b = self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)
            self.nodes[me] = (f, t, a, b, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            f, t, left, right, answer = self.nodes[node]
            if f < 0:
                out[rows] = answer
            elif len(rows):
                low = x[rows, f] <= t
                waiting += [(left, rows[low]), (right, rows[~low])]
        return out


_LONG = "The river rose for three days before the bridge was closed and people began to carry what they could uphill."
_SHORT = "Nobody was hurt."
_LINKS = '<a href="/a">Home</a> <a href="/b">World news</a> <a href="/c">Sport</a>'

_ITEM = '<a href="/n">News</a>'
_STORY = '<a href="/s">Ten bridges that you should know and why they still matter</a>'
_AD = "Buy two pairs of boots and get the third one free today only."
_TITLE = "Flood in the valley"


def _flat(*parts: tuple) -> str:
    """A labelled page of plain elements, without names: (mark, text) or (mark, text, tag) of each block."""
    return "<div>" + "".join(f"<{tag} data-main={mark}>{text}</{tag}>" for mark, text, tag in (
        (*part, "p")[:3] for part in parts)) + "</div>"


#: The labelled table: pages whose blocks are marked by the attribute ``data-main`` of the tag that opens them:
#: 1 is text of the article, 0 is not. The first ones have elements and names that tell; in the flat ones (no
#: article, no names) a block is told by its words and links and by those of its neighbours.
LABELLED = (
    f'<nav><ul><li data-main=0><a href="/">Home</a><li data-main=0><a href="/x">Sport and more</a></ul></nav>'
    f'<article><h1 data-main=1>Flood in the valley</h1><p data-main=1>{_LONG}<p data-main=1>{_SHORT}'
    f'<p data-main=1>{_LONG} {_LONG}</article><footer data-main=0>&copy; The Valley Post. All rights reserved.</footer>',
    f'<div class="ad" data-main=0>Buy two pairs of boots and get the third one free today only.</div>'
    f'<div class="content"><h2 data-main=1>After the storm</h2><p data-main=1>{_LONG}</p><p data-main=1>Yes.</p></div>'
    f'<div class="sidebar" data-main=0>Most read this week {_LINKS}</div><div id="footer" data-main=0>{_LINKS}</div>',
    f'<header><h1 data-main=0>The Valley Post</h1><p data-main=0>News since the year of the great flood.</p></header>'
    f'<main><p data-main=1>{_LONG}</p><ul><li data-main=1>{_SHORT}</li><li data-main=1>The road is open again</li></ul>'
    f'</main><section class="comments"><p data-main=0>{_LONG}</p><p data-main=0>I saw it too, and it was worse.</p></section>',
    f'<form><p data-main=0>Enter your address to get our letter every morning.</p></form><div><p data-main=1>{_LONG} {_LONG}'
    f'</p><p data-main=1>{_LONG}</p></div><div><p data-main=0>{_LINKS}</p></div><div data-main=0>Contact us</div>',
    f'<div class="cookie-notice" data-main=0>We use cookies to make this site work as well as it can for you.</div>'
    f'<article><header><h1 data-main=1>Bridge closed</h1></header><p data-main=1>{_LONG} <a href="/q">See the map</a></p>'
    f'<aside data-main=0>Read also: ten bridges you should know, and why they matter.</aside><p data-main=1>It held.</p></article>',
    f'<table><tr><td data-main=0><a href="/1">One</a><td data-main=0><a href="/2">Two</a></table><div><div data-main=1>{_LONG} {_LONG}'
    f'</div><div data-main=1>{_LONG}</div></div><div data-main=0><a href="/t">Terms of use</a> | <a href="/p">Privacy</a></div>',
    f'<aside><p data-main=0>{_LONG}</p></aside><article><p data-main=1>Short | of | words</p><p data-main=1>More words</p>'
    f'<p data-main=1>{_LONG}</p><div class="share" data-main=0>Share this with your friends.</div></article>'
    f'<footer><p data-main=0>{_LONG}</p></footer>',
    f'<article><p data-main=1>{_SHORT}<p data-main=1>{_SHORT} {_SHORT}<aside><p data-main=0>{_LONG} {_LONG}</aside><p data-main=1>'
    f'<a href="/m">The map</a><p data-main=1>{_LONG}<div class="newsletter"><p data-main=0>{_LONG}</p><p data-main=0>{_SHORT}</p></div>'
    f'<form><p data-main=0>{_LONG}</form><p data-main=1>Of<p data-main=1>{_LONG}<div class="related" data-main=0>{_LINKS}</div>'
    f'<nav data-main=0>{_SHORT}</nav></article><div id="comments"><p data-main=0>{_LONG} {_LONG}</p><p data-main=0>{_SHORT}</p></div>',
    f'<div><p data-main=1>{_LONG}</p><p data-main=1>{_LONG} {_LONG}</p></div><footer><p data-main=0>{_LONG}</p></footer>'
    f'<div class="comments"><p data-main=0>{_LONG} {_LONG}</p><p data-main=0>{_LONG}</p></div><aside data-main=0>{_LONG}</aside>',
    _flat((0, _ITEM), (0, _ITEM), (0, _AD), (1, _TITLE, "h1"), (1, _LONG), (1, "Yes."), (1, _SHORT), (1, _LONG),
          (1, f"{_LONG} {_LONG}"), (0, _ITEM), (0, _ITEM), (0, "&copy; The Valley Post")),
    _flat((0, _LINKS), (1, _TITLE, "h2"), (1, _LONG), (1, '<a href="/m">The map</a>'), (1, _LONG), (1, _SHORT), (1, "Yes."),
          (1, _LONG), (0, _LINKS), (0, "Contact us"), (0, _LINKS)),
    _flat((0, "News since the year of the great flood."), (0, _ITEM), (0, _ITEM), (1, _LONG), (1, _LONG),
          (1, f"{_LONG} {_ITEM}"), (1, _SHORT), (1, f"{_LONG} {_LONG}"), (0, _LINKS), (0, _LINKS)),
    _flat((0, _ITEM), (0, _AD), (0, _ITEM), (1, _TITLE, "h1"), (1, _SHORT), (1, _SHORT), (1, "Yes."), (1, _LONG), (1, _SHORT)),
    _flat((1, _TITLE, "h1"), (1, _LONG), (1, _SHORT), (1, _LONG), (0, "Most read this week", "h3"), (0, _STORY), (0, _STORY)),
    _flat((0, _ITEM), (0, _ITEM), (0, "Boots are cheap today."), (1, f"{_LONG} {_LONG}"), (1, "Yes."), (1, "No."), (1, _LONG),
          (0, _LINKS)),
    _flat((0, _STORY), (0, _STORY), (1, _TITLE, "h1"), (1, "Yes."), (1, _LONG), (1, _LONG), (0, _STORY), (0, _STORY),
          (0, "Read more"), (0, _STORY)),
    _flat((0, _ITEM), (0, _ITEM), (0, _AD), (1, _TITLE, "h1"), (1, "A word"), (1, _LONG), (1, "So it is"), (1, "Of"),
          (1, _LONG), (0, _ITEM)) + f'<footer data-main=0>&copy; The Valley Post. All rights reserved.</footer>',
    # Lists of links and short lines belong to the article where they stand inside its element.
    f'<nav><p data-main=0>{_ITEM}</p></nav><article><p data-main=1>Yes.</p><ul><li data-main=1>{_ITEM}<li data-main=1>{_ITEM}'
    f'<li data-main=1>{_STORY}</ul><p data-main=1>{_SHORT}</p><ul><li data-main=1>{_STORY}<li data-main=1>{_ITEM}</ul></article>'
    f'<p data-main=0>{_ITEM}</p>',
    f'<main><p data-main=1>{_STORY}</p><p data-main=1>{_ITEM}</p><p data-main=1>No.</p><p data-main=1>{_LINKS}</p><p data-main=1>'
    f'{_SHORT}</p><p data-main=1>{_ITEM}</p><p data-main=1>{_SHORT} {_SHORT}</p><p data-main=1>{_STORY}</p></main>',
    f'<article><h1 data-main=1>{_TITLE}</h1><p data-main=1>{_LONG}<p data-main=1>Here they are<ul><li data-main=1>{_ITEM}</ul>'
    f'<p data-main=1>{_SHORT}<p data-main=1>{_STORY}<nav><p data-main=0>{_ITEM}<p data-main=0>{_STORY}</nav><p data-main=1>{_LONG}'
    f'<aside><p data-main=0>{_LINKS}<p data-main=0>{_LONG}</aside><h2 data-main=1>After it</h2><ul><li data-main=1>{_LINKS}</ul>'
    f'<form><p data-main=0>{_LINKS}</form></article>',
    f'<article><h1 data-main=1>{_TITLE}</h1><p data-main=1>{_ITEM}</p><p data-main=1>{_LONG}</p></article>',
    f'<main><p data-main=1>Yes.</p><p data-main=1>{_STORY}</p></main>',
    f'<article><p data-main=1>So it is</p><ul><li data-main=1>{_ITEM}</ul></article><p data-main=0>{_LINKS}</p>',
)


@lru_cache(maxsize=2)
def tree(without: tuple[str, ...] = ()) -> Tree:
    """The tree of the labelled table. Features in ``without`` are not looked at, nor are the blocks that they mark:
    comments in a plain element, say, are told by its name only."""
    x, y = [], []
    for page in LABELLED:
        marks = [int(v) for v in re.findall(r"data-main=(\d)", page)]
        found = blocks(page)
        if len(found) != len(marks):
            raise ValueError("each labelled block needs one mark")
        told = [FEATURES.index(name) for name in without]
        plain = ~(features(found)[:, told] == 1).any(axis=1)
        x.append(features(found, without)[plain])
        y += np.array(marks)[plain].tolist()
    return Tree(np.vstack(x), np.array(y, float))


def main_text(page: bytes, without: tuple[str, ...] = ()) -> str:
    """The article's blocks in page order, joined by line ends."""
    found = blocks(page.decode("utf-8", "replace"))
    return "\n".join(b[0] for b, keep in zip(found, tree(without).predict(features(found, without))) if keep)


def extract_pages(df: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns in ``keep``, ``text`` and ``n_chars`` (its code points)."""
    def extract(raw: bytes) -> tuple[str, int]:
        text = main_text(raw)
        return text, len(text)

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, *keep)}
    return map_texts(df, kinds, page, extract, {"text": "string", "n_chars": "long"})
