"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Features of a block are its word count and link density
(share of words inside links), both also for the block before and after; and, weighed like these, whether
it's a heading, stands in an element that is furniture by tag, role, class or id, and stands in an article
element. A CART tree is grown from the blocks of the small labelled pages below when a worker starts, most
of which have neither telling tags nor names; it cuts by words and links where that is nearly as good.
Of a paragraph's, heading's or list item's class and id only one that is a furniture word alone counts;
of a container's, names that begin or end in one; a name that says how something stands (open, fixed, right)
counts only where no other name says what the container is. A form around an article doesn't make that
furniture, a nav ends where an article starts, and where all articles of a page are in furniture, what is
around them isn't. A section that begins with a heading like "3 comments" is furniture. Lists and short
paragraphs that the tree would drop stay if no furniture parts them from kept blocks before and after them.

Scripts, styles and other raw elements, comments and markup give no blocks, nor do selects, templates and
noscript. Pictures, formulas and media keep the text inside them. Character references are decoded in each
run of text; white space inside a block becomes one space. Unclosed, crossed and cut off tags are
tolerated: a closing tag closes the innermost element of its name if one is open, and what is open in it.
What may look like a tag inside a script or another element without markup is part of it; without a closing
tag it runs to the page's end. A head's own elements give no blocks, so it needs no end: other text is the
body's.

Null html counts as empty; a page without kept blocks has the text ''. Null ids, null urls and repeated
rows pass through, one row each; an empty table gives no rows. Pages are read whole. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._rows import named
from ._worker import slim

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?![^\s=>/])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

#: Elements of HTML by their role in a page.
PLAIN = frozenset("script style textarea title iframe xmp noembed noframes".split())
UNSEEN = frozenset("noscript template select datalist".split())
FURNITURE = frozenset("nav header footer aside form dialog menu button fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("address article aside blockquote button center dd details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table tbody td tr ul".split()) | UNSEEN
INNER = frozenset("p li span h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id attributes that name furniture, and words that say what a page has.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert sidebar side menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist disqus reply replies respond share sharing social newsletter subscribe subscription signup login popup modal overlay related recommended recommendations widget widgets tags pagination pager toolbar search skip hidden copyright".split())
HAVING = frozenset("has have no not with without is".split())
STATES = frozenset("open opened close closed fixed sticky left right top bottom toggle toggled active inactive visible collapsed expanded on off".split())
_COMMENTS = re.compile(r"(?:\d+ |reader |readers' |your )*(?:comments?|responses|replies)(?: \(\d+\))?:?|(?:leave|post|write|add) an? (?:reply|comment):?", re.I)
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in PLAIN}
_PART = re.compile(r"[a-z]+")

FEATURES = ("words before", "links before", "words", "links", "words after", "links after", "heading", "furniture", "article")
#: The labelled pages: a number stands for so many words, kept (+) or not (-).
LABELLED = (
    # no telling tags or names: words and links tell
    "<div><a>-1</a> <a>-4</a></div><h1>+7</h1><p>+62</p><p>+35 <a>+2</a> +9</p><p>+5</p><p>+48</p><div><a>-2</a> <a>-1</a></div><div>-4</div>",
    "<ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><h2>+5</h2><p>+30</p><p>+17</p><p>+80</p><p>+12</p><p>+41</p><ul><li><a>-6</a><li><a>-5</a><li><a>-7</a></ul><div>-8</div>",
    "<table><tr><td><a>-2</a><td><a>-1</a><td><a>-3</a></table><div>+90</div><div>+26 <a>+4</a></div><div>+55</div><table><tr><td><a>-9</a><td>-3</table>",
    "<div><a>-1</a> | <a>-1</a> | <a>-2</a></div><div>-3</div><div>-5</div><h1>+9</h1><div>+120 <a>+3</a> +40 <a>+2</a></div><div>+70</div><div>-2 <a>-3</a></div><div>-6</div>",
    "<div>-2</div><p>+24</p><p>+31</p><p>+8</p><p>+65</p><div><a>-12</a></div><div><a>-10</a> -4</div><div><a>-14</a></div>",
    "<div><a>-30</a></div><div>-6 <a>-25</a></div><h1>+4</h1><p>+38</p><p>+52</p><p>+19</p><div>-3 <a>-4</a> -2 <a>-6</a></div><div><a>-1</a></div>",
    "<p>+150</p><p>+95</p><p>+60</p><div><a>-1</a></div><div>-1</div>",
    "<ul><li><a>-3</a><li><a>-2</a></ul><div>-3</div><h2>+6</h2><p>+44</p><ul><li>+11<li>+14<li>+9</ul><p>+27</p><div><a>-8</a></div><div>-2 <a>-2</a></div>",
    "<div>-4 <a>-9</a></div><div><a>-7</a></div><div>-1</div><div><a>-5</a></div>",
    "<div><a>-1</a></div><div>-7</div><div><a>-20</a></div><div>-2</div><div><a>-3</a></div><div>-10 <a>-12</a></div>",
    "<p>+40</p><p>+75</p>", "<div>+130</div>", "<div><a>-2</a> <a>-1</a></div><h1>+6</h1><p>+18</p><p>+34</p>", "<div><a>-3</a></div><p>+52</p>", "<div>-3</div>", "<div><a>-1</a></div><div>-4</div>", "<div>-2</div><div>-6</div>",
    # articles that are elements: all of them stays, furniture in them doesn't
    "<ul><li><a>-1</a><li><a>-1</a></ul><article><h1>+9</h1><p>+40</p><p>+3</p><p><a>+6</a></p><p>+1</p><p>+22 <a>+14</a></p><p>+2</p></article><div>-9</div>",
    "<div>-6</div><article><p>+12</p><p>+2</p><p>+1</p><p>+1</p></article><div>-5</div><div><a>-3</a></div>",
    "<div><a>-2</a></div><main><h1>+3</h1><p>+2</p><ul><li><a>+2</a><li><a>+5</a><li>+4</ul><p>+70</p><h2>+2</h2><p>+6</p></main><div>-12</div>",
    "<article><p>+64</p><p>+3</p></article>", "<article><p>+30</p><p>+12</p></article>", "<article><h1>+4</h1><p>+40</p><p>+20</p></article>", "<div>-2</div><article><p>+2</p><p>+16</p></article>", "<article><p><a>+24</a></p><p>+80</p><p><a>+9</a></p></article>", "<main><p>+9</p></main>", "<article>+1</article>", "<article><p><a>+3</a></p><p><a>+16</a></p></article>", "<div><a>-18</a></div><article><p>+26</p></article><div><a>-11</a></div>",
    "<article><p>+1</p></article><div>-3</div><article><p><a>+1</a></p><p>+5</p></article><div><a>-1</a></div>",
    "<article><h1>+8</h1><p>+33</p><aside>-28</aside><p>+51</p><aside><h3>-2</h3><p><a>-9</a></p><p>-16</p></aside><p>+4</p><div class=comments><h3>-2</h3><p>-45</p><p>-6</p><p>-72</p></div></article>",
    "<article><header><h1>+6</h1><p>-4</p></header><p>+58</p><p>+10</p><form><p>-11</p></form><footer>-18</footer></article>",
    # furniture by element or name, prose of all lengths among it
    "<nav><ul><li><a>-1</a><li>-2</ul></nav><header>-5</header><div class=cookie-notice>-38</div><article><h1>+7</h1><p>+25</p><p>+90</p></article><div id=comments><p>-50</p><p>-14</p><p>-33</p></div><footer>-21</footer>",
    "<header><h1>-3</h1><p>-9</p></header><h2>+6</h2><p>+45</p><p>+78</p><p>+20</p><aside><h3>-2</h3><p>-40</p><p>-64</p></aside><footer><p>-30</p></footer>",
    "<div class=ad>-9</div><p>+37</p><p>+61</p><div class=ad>-24</div><p>+29</p><div class=sidebar><p>-55</p><p>-18</p></div>",
    "<div class=banner>-70</div><form><p>-22</p><p>-41</p></form><div>+66</div><div>+85</div><div class=newsletter>-26</div><div class=related><p>-31</p><p>-47</p></div>",
    "<div class=notice>-16</div><p>+57</p><p>+33</p><ol class=commentlist><li>-60<li>-8<li>-110</ol>",
)
_NUMBER = re.compile(r"([+-])(\d+)")


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    keep: bool = False

    def decide(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.keep


def grow(x: np.ndarray, y: np.ndarray, first: int, enough: float = 0.6, depth: int = 10) -> Node:
    """A CART classification tree by Gini impurity. A cut by one of the first features is taken if it gains
    at least ``enough`` of what the best cut does; of equal cuts the first feature's lowest."""
    here = Node(keep=bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return here
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v)
    cuts: list[tuple[float, int, float]] = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            side = x[:, f] <= cut
            cuts.append((gini(y) - gini(y[side]) - gini(y[~side]), f, float(cut)))
    best = max(cuts, key=lambda c: c[0], default=(0.0, 0, 0.0))
    if best[0] <= 1e-9:
        return here
    early = max((c for c in cuts if c[1] < first), key=lambda c: c[0], default=(0.0, 0, 0.0))
    _, here.feature, here.cut = early if early[0] >= enough * best[0] else best
    side = x[:, here.feature] <= here.cut
    here.low, here.high = grow(x[side], y[side], first, enough, depth - 1), grow(x[~side], y[~side], first, enough, depth - 1)
    return here


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """(features, kept) of the blocks of the labelled pages."""
    x, y = [], []
    for page in LABELLED:
        found = blocks(_NUMBER.sub(lambda m: " ".join(("K" if m[1] == "+" else "D") * int(m[2])), page))
        x += features(found)
        y += [b[0][0] == "K" for b in found]
    return np.array(x, float), np.array(y, float)


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled(), first=FEATURES.index("heading"))


@lru_cache(maxsize=4096)
def _is_furniture(tag: str, attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if tag in INNER:
                if value.strip() in NAMES:
                    return True
                continue
            tokens = [_PART.findall(token) for token in value.split()]
            named_by = [t for t in tokens if t and t[0] not in HAVING and (t[0] in NAMES or t[-1] in NAMES or t[0] in STATES and NAMES.intersection(t))]
            plain = len(named_by) < len(tokens)  # another name says what it is
            if any(not (plain and STATES.intersection(t)) for t in named_by):
                return True
        elif name == "role":
            if value in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


Block = tuple[str, int, int, bool, bool, bool]


class _Page:
    """What is open at a place of a page."""

    def __init__(self, inside: bool = False):
        self.inside = inside  # articles are none of the furniture around them
        self.out: list[Block] = []
        self.stack: list[tuple[str, int, int, int, int, int]] = []  # element, what it adds to the counts, and blocks before it:
        self.furniture = self.article = self.titles = self.unseen = 0
        self.runs: list[str] = []
        self.linked = self.link = 0
        self.heading = False

    def text(self, raw: str) -> None:
        if not self.unseen:
            text = html.unescape(raw)
            self.runs.append(text)
            if self.link:
                self.linked += len(text.split())

    def flush(self) -> None:
        if self.runs:
            words = "".join(self.runs).split()
            if words:
                if self.heading and _COMMENTS.fullmatch(" ".join(words)):
                    self.part()
                furniture = self.furniture > 0 and not (self.heading and self.furniture == self.titles)
                self.out.append((" ".join(words), len(words), min(self.linked, len(words)), self.heading, furniture, self.article > 0))
            self.runs.clear()
        self.linked = 0

    def part(self) -> None:
        """Makes the section furniture that begins here, if one does."""
        i = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] not in INNER), -1)
        if i >= 0 and self.stack[i][0] in ("section", "div") and self.stack[i][5] == len(self.out):
            self.stack[i] = (self.stack[i][0], self.stack[i][1] + 1, *self.stack[i][2:])
            self.furniture += 1

    def _add(self, entry: tuple[str, int, int, int, int, int], times: int) -> None:
        self.furniture += times * entry[1]
        self.article += times * entry[2]
        self.titles += times * entry[3]
        self.unseen += times * entry[4]

    def open(self, tag: str, attributes: str) -> None:
        marked = tag in FURNITURE or bool(attributes) and _is_furniture(tag, attributes)
        if tag in INNER:
            if tag in ("p", "li") and any(e[0] == tag for e in self.stack[-1:]):  # a new one ends the one that is open
                self.close(tag)
            if not marked:
                return
        if marked or tag in UNSEEN:
            self.flush()
        article = tag in ("article", "main") and not marked
        if article:
            while any(e[0] == "nav" for e in self.stack):
                self.close("nav")
        # an article isn't furniture for the forms around it
        forms = sum(e[1] for e in self.stack if e[0] == "form") if article and all(e[0] == "form" for e in self.stack if e[1] > 0) else 0
        around = self.furniture if article and self.inside else forms
        entry = (tag, 1 if marked else -around, int(article), int(tag == "header" and self.article > 0), int(tag in UNSEEN), len(self.out))
        self.stack.append(entry)
        self._add(entry, 1)

    def close(self, tag: str) -> None:
        """Closes the innermost element of the name, and what is open in it."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                for e in self.stack[i:]:
                    if e[4]:
                        self.flush()
                    self._add(e, -1)
                del self.stack[i:]
                break


def blocks(page: str) -> list[Block]:
    """(text, words, words in links, heading, in furniture, in an article) of the page's text blocks."""
    found = _walk(page, False)
    inner = [b for b in found if b[5]]
    return found if not inner or not all(b[4] for b in inner) else _walk(page, True)


def _walk(page: str, inside: bool) -> list[Block]:
    now, at = _Page(inside), 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            now.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in PLAIN:
            if not closing and not (attributes.endswith("/") and tag not in ("script", "style", "title")):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
        elif tag == "a":
            now.link = not closing
        elif tag == "br":
            now.text(" ")
        elif tag:
            if tag in BLOCKS:
                now.flush()
                now.link = 0
                now.heading = tag in HEADINGS and not closing
            if tag in CONTAINERS or tag in INNER:
                if closing:
                    now.close(tag)
                elif not attributes.endswith("/") or tag not in VOID:
                    now.open(tag, attributes)
    if at < len(page):
        now.text(page[at:])
    now.flush()
    return now.out


def features(found: list[Block]) -> list[tuple]:
    size = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    return [(*size[i], *size[i + 1], *size[i + 2], b[3], b[4], b[5]) for i, b in enumerate(found)]


def joined(found: list[Block], keep: list[bool]) -> list[bool]:
    """Keeps also what lies between kept blocks, if it has no furniture and few links in it."""
    out, waiting = list(keep), None
    for i, b in enumerate(found):
        if keep[i]:
            for j in waiting or ():
                out[j] = True
            waiting = []
        elif b[4] or 3 * b[2] > b[1]:
            waiting = None
        elif waiting is not None:
            waiting.append(i)
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = joined(found, [tree().decide(x) for x in features(found)])
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(b["html"][i].as_py()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])
        slim()

    return pages.select(named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"), named(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
