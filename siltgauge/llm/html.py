"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. A block has its number of words, its link
density, both for its neighbours, and what the tags around it say: whether it lies in an
article, in a part that is never content, or in an element whose class or id names one. A name
says nothing of an element that holds most of the page's text. A small labelled table teaches a
decision tree, which then classifies the blocks of every page.

Reading takes one pass, in time that grows with the page's length whatever its markup.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import widen

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noframes noscript object ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Their content is no text of the page, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe template svg math canvas object noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
NEVER = frozenset("nav header footer aside button select menu dialog fieldset label option head noscript".split())
INSIDE = frozenset(("article", "main"))
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes and ids that name parts that are no content.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion promotions promoted comment comments commentlist "
    "disqus respond replies reply sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommend recommended recommendation recommendations footer foot header masthead topbar toolbar "
    "pagination pager copyright legal disclaimer tag tags byline trending popular outbrain taboola skiplink search".split()
)
#: Share of the page's words without links and outside NEVER beyond which a name is void: where the
#: name is a part of a compound, and where it is a whole class or the element is a form.
VOID_PART, VOID_WHOLE = 0.5, 0.9
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
QUOTED = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+>")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
PARTS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "words", "linked", "tag", "never", "named", "hint", "inside")

    def __init__(self, text: str, linked: int, tag: str, never: bool, named: int, inside: bool):
        self.text, self.tag, self.never, self.named, self.inside = text, tag, never, named, inside
        self.words = len(text.split())
        self.linked = linked
        self.hint = False


def named_part(name: str, value: str) -> int:
    """0: names nothing; 1: a part of a compound names what is no content; 2: a whole class or id does, or it is a form."""
    if name == "form":
        return 2
    if not value or name in ("body", "html", "main", "article"):
        return 0
    if any(x in HINTS or x.replace("-", "").replace("_", "") in HINTS for x in value.split()):
        return 2
    return int(any(x in HINTS for x in PARTS.findall(value)))


class Reader:
    """Cuts markup into (text, name, closing, attributes); text goes before the tag. Every byte is passed a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.quotes = True  # until a quote is never closed: then tags end at the first ">"
        self.missing: set[str] = set()  # elements of which no further end exists

    def _after(self, mark: str, at: int) -> int:
        k = self.page.find(mark, at)
        return len(self.page) if k < 0 else k + len(mark)

    def tags(self):
        page, n, text_from = self.page, len(self.page), 0
        while True:
            at = page.find("<", self.at)
            if at < 0:
                yield page[text_from:], "", False, ""
                return
            head = page[at + 1 : at + 3]
            if head[:1] in ("!", "?"):
                end = self._after("-->", at + 4) if page.startswith("<!--", at) else self._after("]]>" if page.startswith("<![CDATA[", at) else ">", at + 2)
                yield page[text_from:at], "", False, ""
                self.at = text_from = end
                continue
            closing = head[:1] == "/"
            name = NAME.match(page, at + 1 + closing)
            if name is None:
                self.at = at + 1  # a sign, no tag
                continue
            end = 0
            if self.quotes:
                m = QUOTED.match(page, name.end())
                if m is None:
                    self.quotes = False
                else:
                    end = m.end()
            if not end:
                end = self._after(">", name.end())
            self.at = end
            yield page[text_from:at], name[0].lower(), closing, page[name.end() : end].removesuffix(">")
            text_from = self.at

    def skip(self, name: str, to_end: bool) -> None:
        """Go on behind the element's end; where there is none, at once, or at the page's end."""
        end = None if name in self.missing else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(self.page, self.at)
        if end is None:
            self.missing.add(name)
        self.at = end.end() if end else len(self.page) if to_end else self.at


def blocks(page: str) -> list[Block]:
    """Flat text blocks in page order, character references decoded and white space made one."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, never, innermost named element or -1, inside
    open_: Counter = Counter()
    above: list[int] = []  # for each named element, the one around it
    strength: list[int] = []
    parts: list[str] = []
    linked, in_link, tag = 0, False, ""

    def flush() -> None:
        nonlocal linked
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            _, never, named, inside = stack[-1] if stack else ("", False, -1, False)
            out.append(Block(text, linked, tag, never, named, inside))
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        open_[name] -= 1
        return name

    reader = Reader(page)
    for raw, name, closing, attrs in reader.tags():
        if raw:
            text = entities.unescape(raw)
            parts.append(text)
            if in_link:
                linked += len(text.split())
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link = not closing
        if not closing and name in RAW and not attrs.endswith("/"):
            flush()
            reader.skip(name, name in ("script", "style"))
            continue
        if name in BLOCK:
            flush()
        if closing:
            if open_[name] and not (name in ("p", "li", "b", "i", "a", "span") and name not in [s[0] for s in stack[-6:]]):
                while pop() != name:
                    pass
        elif name not in VOID and not attrs.rstrip().endswith("/"):
            if name in CLOSES:
                while stack and stack[-1][0] in (CLOSES[name] | {"b", "i", "em", "strong", "span", "a"}) and any(s[0] in CLOSES[name] for s in stack[-4:]):
                    pop()
            _, never, named, inside = stack[-1] if stack else ("", False, -1, False)
            value, hidden = "", False
            if attrs:
                for a in ATTRIBUTE.finditer(attrs):
                    key, v = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key in ("class", "id"):
                        value += " " + v
                    elif key == "role":
                        hidden |= v in ROLES
                    elif key == "aria-hidden":
                        hidden |= v == "true"
                    elif key == "style":
                        hidden |= "display:none" in v.replace(" ", "")
                hidden |= bool(HIDDEN.search(attrs))
            # a header of the article itself holds its headline
            never = never or hidden or (name in NEVER and not (name == "header" and inside))
            kind = named_part(name, value)
            if kind:
                above.append(named)
                strength.append(kind)
                named = len(above) - 1
            stack.append((name, never, named, inside or name in INSIDE))
            open_[name] += 1
            if name in BLOCK:
                tag = name
    flush()
    _hints(out, above, strength)
    return out


def _hints(found: list[Block], above: list[int], strength: list[int]) -> None:
    """Mark the blocks in named elements, but for elements that hold most of the page's words."""
    held, total = [0] * len(above), 0
    for b in found:
        plain = 0 if b.never else max(0, b.words - b.linked)
        total += plain
        if b.named >= 0:
            held[b.named] += plain
    for k in range(len(above) - 1, -1, -1):  # what is inside comes after
        if above[k] >= 0:
            held[above[k]] += held[k]
    hint = []
    for k, up in enumerate(above):
        void = held[k] > (VOID_WHOLE if strength[k] == 2 else VOID_PART) * total
        hint.append(not void or (up >= 0 and hint[up]))
    for b in found:
        b.hint = b.named >= 0 and hint[b.named]


#: words, link density, words and link density of the block before and after, inside an
#: article, an article exists on the page, inside a part that is never content, a hint by
#: class or id, a heading.
NAMES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "page_has_inside", "never", "hint", "heading")

#: The labelled table: features as above, and whether the block belongs to the main text.
#: Made by hand from common layouts of pages.
LABELLED = [
    # pages with an article element: its paragraphs and headlines, short ones included
    (9, 0, 4, 0, 60, 0, 1, 1, 0, 0, 1, 1), (60, 0, 9, 0, 80, 0.05, 1, 1, 0, 0, 0, 1), (80, 0.05, 60, 0, 35, 0, 1, 1, 0, 0, 0, 1), (1, 0, 80, 0, 40, 0, 1, 1, 0, 0, 0, 1),
    (3, 0, 40, 0, 2, 0, 1, 1, 0, 0, 0, 1), (2, 0, 3, 0, 7, 1, 1, 1, 0, 0, 0, 1), (150, 0.02, 12, 0, 90, 0, 1, 1, 0, 0, 0, 1), (12, 0.5, 150, 0, 90, 0, 1, 1, 0, 0, 0, 1),
    (7, 0, 12, 0, 7, 0, 1, 1, 0, 0, 0, 1), (25, 0.3, 30, 0, 30, 0, 1, 1, 0, 0, 0, 1), (5, 0, 6, 0, 0, 0, 1, 1, 0, 0, 0, 1), (4, 0, 8, 0, 60, 0, 1, 1, 0, 0, 1, 1),
    (1, 0, 1, 1, 60, 0, 1, 1, 0, 0, 1, 1), (11, 0, 0, 0, 0, 0, 1, 1, 0, 0, 1, 1), (30, 0, 25, 0, 8, 0.3, 1, 1, 0, 0, 0, 1), (8, 0.9, 30, 0, 30, 0, 1, 1, 0, 0, 0, 1), (1, 0, 1, 0, 1, 0, 1, 1, 0, 0, 0, 1),
    # the same pages: links and adverts inside the article element, by name
    (6, 0, 70, 0, 50, 0, 1, 1, 0, 1, 0, 0), (20, 0, 60, 0, 40, 0, 1, 1, 0, 1, 0, 0), (40, 0.1, 40, 0, 40, 0, 1, 1, 0, 1, 0, 0), (5, 1, 40, 0, 5, 1, 1, 1, 0, 1, 0, 0),
    (3, 0, 30, 0, 3, 0, 1, 1, 1, 0, 0, 0), (8, 0.5, 50, 0, 8, 0.5, 1, 1, 1, 0, 0, 0), (30, 0, 50, 0, 20, 0, 1, 1, 1, 0, 0, 0), (2, 1, 50, 0, 2, 1, 1, 1, 1, 1, 0, 0),
    # the same pages: what stands beside the article
    (1, 1, 1, 1, 1, 1, 0, 1, 1, 0, 0, 0), (2, 1, 1, 1, 10, 0, 0, 1, 1, 0, 0, 0), (9, 0, 1, 1, 8, 0, 0, 1, 0, 1, 0, 0), (14, 0, 60, 0, 0, 0, 0, 1, 1, 0, 0, 0),
    (25, 0, 2, 1, 30, 0, 0, 1, 0, 0, 0, 0), (70, 0, 12, 0, 60, 0, 0, 1, 0, 0, 0, 0), (5, 0, 3, 0, 9, 0, 0, 1, 0, 0, 1, 0), (90, 0, 40, 0, 50, 0, 0, 1, 0, 1, 0, 0),
    (12, 0.2, 50, 0, 12, 0.2, 0, 1, 0, 0, 0, 0), (40, 0, 40, 0, 0, 0, 0, 1, 1, 1, 0, 0), (3, 0, 0, 0, 1, 1, 0, 1, 0, 0, 0, 0), (33, 0.1, 3, 0, 12, 0, 0, 1, 0, 0, 0, 0),
    # pages without one: text by length, links and neighbours
    (60, 0, 8, 0, 70, 0, 0, 0, 0, 0, 0, 1), (45, 0.1, 60, 0, 30, 0, 0, 0, 0, 0, 0, 1), (28, 0, 45, 0, 50, 0.1, 0, 0, 0, 0, 0, 1), (120, 0.05, 2, 1, 60, 0, 0, 0, 0, 0, 0, 1),
    (16, 0, 60, 0, 50, 0, 0, 0, 0, 0, 0, 1), (9, 0, 45, 0, 60, 0, 0, 0, 0, 0, 0, 1), (6, 0, 70, 0, 40, 0, 0, 0, 0, 0, 1, 1), (8, 0, 2, 1, 70, 0, 0, 0, 0, 0, 1, 1),
    (7, 0, 0, 0, 60, 0, 0, 0, 0, 0, 1, 1), (5, 0, 1, 1, 40, 0, 0, 0, 0, 0, 1, 1), (12, 0, 70, 0, 3, 0.8, 0, 0, 0, 0, 0, 1), (4, 0, 50, 0, 40, 0, 0, 0, 0, 0, 0, 1),
    (22, 0, 7, 0, 25, 0, 0, 0, 0, 0, 0, 1), (40, 0, 6, 0, 5, 1, 0, 0, 0, 0, 0, 1), (3, 0, 28, 0, 45, 0, 0, 0, 0, 0, 0, 1), (200, 0.2, 10, 0, 12, 0, 0, 0, 0, 0, 0, 1),
    (2, 1, 2, 1, 2, 1, 0, 0, 0, 0, 0, 0), (1, 1, 0, 0, 1, 1, 0, 0, 0, 0, 0, 0), (5, 1, 60, 0, 4, 1, 0, 0, 0, 0, 0, 0), (4, 0, 1, 1, 3, 1, 0, 0, 0, 0, 0, 0),
    (8, 0.8, 3, 1, 60, 0, 0, 0, 0, 0, 0, 0), (20, 0.9, 12, 0.8, 18, 0.9, 0, 0, 0, 0, 0, 0), (30, 0.7, 10, 0.5, 25, 0.8, 0, 0, 0, 0, 0, 0), (6, 0, 3, 1, 2, 1, 0, 0, 0, 0, 0, 0),
    (3, 0, 2, 1, 1, 1, 0, 0, 0, 0, 1, 0), (2, 0, 2, 0.9, 3, 0.5, 0, 0, 0, 0, 0, 0), (7, 0, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0), (5, 0.4, 4, 1, 0, 0, 0, 0, 0, 0, 0, 0),
    (10, 0, 3, 1, 4, 0, 0, 0, 0, 0, 0, 0), (4, 0, 6, 1, 5, 1, 0, 0, 0, 0, 1, 0), (9, 0.5, 5, 1, 5, 1, 0, 0, 0, 0, 0, 0), (6, 0.6, 50, 0, 50, 0, 0, 0, 0, 0, 0, 0),
    (30, 0, 10, 0, 10, 0, 0, 0, 0, 0, 0, 1), (12, 0, 30, 0, 3, 0, 0, 0, 0, 0, 0, 1), (3, 0, 12, 0, 20, 0, 0, 0, 0, 0, 0, 1), (2, 0, 20, 0, 5, 0, 0, 0, 0, 0, 0, 1),
    (20, 0, 5, 0, 2, 0, 0, 0, 0, 0, 0, 1), (18, 0, 18, 0, 18, 0, 0, 0, 0, 0, 0, 1), (50, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (10, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1),
    (3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), (5, 0, 2, 0, 20, 0, 0, 0, 0, 0, 0, 1), (6, 0.2, 5, 0.2, 7, 0, 0, 0, 0, 0, 0, 1), (15, 0.3, 20, 0.1, 10, 0.3, 0, 0, 0, 0, 0, 1),
    (25, 0.1, 3, 1, 14, 0, 0, 0, 0, 0, 0, 1), (80, 0, 2, 1, 3, 1, 0, 0, 0, 0, 0, 1), (5, 0, 0, 0, 22, 0, 0, 0, 0, 0, 1, 1), (6, 0, 3, 1, 20, 0, 0, 0, 0, 0, 1, 1),
    (4, 0, 20, 0, 2, 0, 0, 0, 0, 0, 1, 1), (20, 0, 4, 0, 2, 0, 0, 0, 0, 0, 0, 1), (2, 0, 4, 0, 5, 0, 0, 0, 0, 0, 0, 1), (5, 0, 2, 0, 10, 0, 0, 0, 0, 0, 0, 1),
    (17, 0, 5, 0, 0, 0, 0, 0, 0, 0, 0, 1), (45, 0.05, 17, 0, 0, 0, 0, 0, 0, 0, 0, 1), (24, 0, 30, 0, 3, 1, 0, 0, 0, 0, 0, 1), (9, 0, 24, 0, 6, 0, 0, 0, 0, 0, 0, 1),
    (3, 0.5, 4, 0.6, 3, 0.4, 0, 0, 0, 0, 0, 0), (12, 0.6, 20, 0, 20, 0, 0, 0, 0, 0, 0, 0), (3, 0, 2, 1, 3, 0.7, 0, 0, 0, 0, 0, 0), (4, 0, 5, 0.9, 0, 0, 0, 0, 0, 0, 0, 0),
    # the same pages: parts that are never content, and those that are named so
    (40, 0, 40, 0, 30, 0, 0, 0, 1, 0, 0, 0), (10, 0, 60, 0, 0, 0, 0, 0, 1, 0, 0, 0), (2, 1, 3, 1, 8, 0, 0, 0, 1, 0, 0, 0), (15, 0.1, 2, 1, 60, 0, 0, 0, 1, 0, 0, 0),
    (35, 0, 60, 0, 40, 0, 0, 0, 0, 1, 0, 0), (12, 0, 8, 0, 60, 0, 0, 0, 0, 1, 0, 0), (60, 0, 50, 0, 70, 0, 0, 0, 0, 1, 0, 0), (5, 1, 5, 1, 60, 0, 0, 0, 0, 1, 0, 0),
    (8, 0, 60, 0, 50, 0, 0, 0, 0, 1, 1, 0), (100, 0.02, 30, 0, 80, 0, 0, 0, 1, 1, 0, 0), (6, 0, 1, 1, 60, 0, 0, 0, 1, 0, 1, 0), (7, 0, 60, 0, 30, 0, 0, 0, 1, 1, 1, 0),
]


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([min(1.0, b.linked / b.words) if b.words else 0.0 for b in found])
    before = lambda x: np.concatenate(([0.0], x[:-1])) if n else x
    after = lambda x: np.concatenate((x[1:], [0.0])) if n else x
    inside = np.array([b.inside for b in found], float)
    has = np.full(n, float(inside.any())) if n else inside
    rest = [np.array([getattr(b, k) for b in found], float) for k in ("never", "hint")]
    heading = np.array([len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit() for b in found], float)
    return np.stack([words, links, before(words), before(links), after(words), after(links), inside, has, *rest, heading], 1) if n else np.zeros((0, len(NAMES)))


class Tree:
    """A binary decision tree grown by Gini impurity; ties take the first feature and cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most_depth: int = 10):
        self.root = self._grow(x, y, most_depth)

    def _grow(self, x, y, depth):
        ones = int(y.sum())
        if depth == 0 or ones in (0, len(y)):
            return bool(2 * ones >= len(y))
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            left = np.cumsum(t)[:-1]
            n = np.arange(1, len(t))
            cost = left * (n - left) / n + (ones - left) * (len(t) - n - ones + left) / (len(t) - n)
            cost = np.where(v[1:] > v[:-1], cost, np.inf)
            k = int(cost.argmin()) if len(cost) else 0
            if len(cost) and np.isfinite(cost[k]) and (best is None or cost[k] < best[0] - 1e-12):
                best = (cost[k], f, (v[k] + v[k + 1]) / 2)
        if best is None:
            return bool(2 * ones >= len(y))
        _, f, cut = best
        low = x[:, f] <= cut
        return f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)

        def down(node, rows):
            if isinstance(node, bool):
                out[rows] = node
                return
            f, cut, low, high = node
            under = x[rows, f] <= cut
            down(low, rows[under])
            down(high, rows[~under])

        down(self.root, np.arange(len(x)))
        return out


@lru_cache(1)
def default_tree() -> Tree:
    table = np.array(LABELLED, float)
    return Tree(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The blocks that the tree calls content, in page order, with an empty line between."""
    found = blocks(page or "")
    keep = (tree or default_tree()).predict(features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, html: str = "html", tree: Tree | None = None) -> DataFrame:
    """pages with text and n_chars in place of the html.

    Defined cases: a null or empty page has the empty text; markup that never ends runs to the
    page's end, and once a quote in a tag is never closed, tags end at the first ">"; very long
    pages are read whole, in linear time; repeated rows get equal results; columns named text and
    n_chars are replaced.
    """

    def run(pdf: pd.DataFrame) -> dict:
        texts = [main_text(x if isinstance(x, str) else "", tree) for x in pdf[html]]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return widen(pages, run, "text string, n_chars long", drop=(html,))
