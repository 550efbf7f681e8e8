"""Main text of HTML pages by composite text density.

The page is parsed into a DOM (tag soup allowed), elements that are never part of
an article by their tag or state (scripts, menus, footers, asides, hidden ones)
are taken out, and every other node gets the composite density of Sun, Song and
Liao (SIGIR 2011): characters per tag, adjusted by the share of characters and
tags inside links.  The node with the largest sum of child densities is the
centre of the page; the smallest density on its path to the body is the
threshold above which further subtrees count.

Classes and ids are weighed, not obeyed.  A box that is named like furniture
competes for the centre with ``NAMED`` of its sum, and joins no other centre.
Inside the centre a box goes only if one of its classes or its id is itself such
a name and its density is under the threshold, or if it is named as an advert, a notice or
reader comments and holds less than half of the text.  Headings and list items stay; so
do buttons and labels that stand inside a run of prose.
The centre is widened to the ``article`` element around it, so that the heading
comes along; which article that is, density decides.  The body competes with its
own paragraphs only, as its other children compete themselves.

Defined results: a null, empty or tagless-and-blank page gives an empty text; a
page whose furniture removal leaves nothing gives an empty text; of equal sums
the first node in page order wins; repeated rows give repeated results; of the
input only the html column is read, and a column that is named as the output is
replaced.  Parsing is iterative, so depth and length are not limited.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import bounded_batches

#: A tag: name, attributes (quoted values end at their quote, others at a blank or the end), and whether it is closed.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)?+)?+|=)*+)(>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold a run of text rather than other blocks; a choice of one of them is raised to its parent.
_RUN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr tbody thead caption figcaption summary address hgroup".split())
#: A start tag ends an open element of these names, up to the given barriers.
_HEAD_P = _BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot caption".split())
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Never part of an article.
_FURNITURE = frozenset(
    "head title script style noscript template nav footer aside select textarea option input legend iframe object embed "
    "svg canvas audio video map menu dialog applet frame frameset noframes noembed".split()
)
#: Words of a sentence, or controls of a page.
_CONTROLS = frozenset(("button", "label"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 li".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog".split())
#: Parts of a class or id that hint at furniture.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav navbar "
    "navigation topnav breadcrumb breadcrumbs masthead topbar footer comment comments disqus respond replies discussion "
    "social share sharing sharebar related recommended recommendations widget widgets login signin signup toolbar pagination pager "
    "skiplink paywall disclaimer".split()
)
#: Whole classes and ids that name furniture inside an article.
_TOKENS = frozenset(
    "ad ads advert advertisement adsbygoogle ad-banner ad-container ad-slot banner sponsored promo cookie-notice cookie-banner notice notification popup newsletter "
    "newsletter-signup sidebar menu navbar breadcrumb breadcrumbs share-buttons social-share related-posts pagination widget".split()
)
#: Those of them that hold adverts and notices, however dense.
_CERTAIN = _TOKENS - frozenset("banner promo menu widget navbar".split())
#: First parts of classes and ids of adverts.
_ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored".split())
#: Whole classes and ids of reader comments.
_COMMENTS = frozenset("comment comments comment-list commentlist comments-area comments-section comment-section comments-list comment-thread disqus_thread user-comments reader-comments".split())
#: What the sum of a box that is named like furniture counts for.
NAMED = 0.25


_KINDS = ("", "other", "certain", "comments")


class _Node:
    __slots__ = ("tag", "parent", "items", "gone", "hint", "named", "chars", "tags", "lchars", "ltags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, gone: bool = False, hint: bool = False, named: str = ""):
        self.tag, self.parent, self.items, self.gone, self.hint, self.named = tag, parent, [], gone, hint, named
        self.chars = self.tags = self.lchars = self.ltags = 0
        self.density = self.total = 0.0


def _read_attributes(tag: str, attrs: str) -> tuple[bool, bool, str]:
    """(gone, hint, named) of an element: whether it is no part of any article, has a part of furniture's names, and which kind it is named as a whole."""
    if tag in _FURNITURE:
        return True, False, ""
    hint, named = False, ""
    for name, a, b, c in _ATTR.findall(attrs) if attrs.strip() else ():
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, False, ""
        if name == "role" and value.lower() in _ROLES:
            return True, False, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, ""
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for token in value.split():
                plain = _CAMEL.sub("-", token).lower()
                words = _NAMES.findall(plain)
                certain = plain in _CERTAIN or bool(words) and words[0] in _ADVERTS
                kind = "comments" if plain in _COMMENTS else "certain" if certain else "other" if plain in _TOKENS else ""
                named = max(named, kind, key=_KINDS.index)
                # "has-sidebar" and "no-ads" say what a box is not
                hint = hint or (bool(words) and words[0] not in ("has", "with", "no", "without") and not _WORDS.isdisjoint(words))
    return False, hint, named


class _Open:
    """The open elements, innermost last, with their places by name, so that no tag looks through all of them."""

    def __init__(self, body: _Node):
        self.stack, self.where, self.blocks, self.hard = [body], {}, [], []

    def last(self, tag: str) -> int:
        """Place of the innermost open element of this name; 0, the body's, if there is none."""
        found = self.where.get(tag)
        return found[-1] if found else 0

    def push(self, node: _Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in _BLOCK:
            self.blocks.append(at)
            if node.tag not in ("p", "li"):
                self.hard.append(at)

    def close(self, at: int) -> None:
        """End the element at this place and all inside it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            for some in (self.blocks, self.hard):
                if some and some[-1] == len(self.stack):
                    some.pop()


def parse(page: str) -> _Node:
    """The page's tree.  ``items`` holds texts and nodes in page order; furniture is marked ``gone``.  Takes time in proportion to the page's length."""
    root = _Node("html", None)
    body = _Node("body", root)
    root.items.append(body)
    controls: list[_Node] = []
    opened = _Open(body)
    at, end = 0, len(page)
    search = _TAG.search
    while at < end:
        now = opened.stack[-1]
        m = search(page, at)
        if m is None:
            if (lt := page.rfind("<", at)) >= 0 and re.match(r"</?[a-zA-Z][^>]*\Z", page[lt:]):
                page = page[:lt]
            if at < len(page) and not now.gone:
                now.items.append(page[at:])
            break
        if m.start() > at and not now.gone:
            now.items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[4]:  # the page ends inside this tag
            break
        if m[1]:
            if tag in ("html", "body", "br"):
                continue
            place = opened.last(tag)
            if place and (tag in _BLOCK or not opened.hard or place > opened.hard[-1]):  # an inline end tag ends nothing outside its block
                opened.close(place)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _HEAD_P:
            if opened.blocks and opened.stack[opened.blocks[-1]].tag == "p":
                opened.close(opened.blocks[-1])
        elif tag in _ENDS:
            names, stops = _ENDS[tag]
            place = max(opened.last(x) for x in (*names, *stops))
            if opened.stack[place].tag in names:
                opened.close(place)
        now = opened.stack[-1]
        gone, hint, named = _read_attributes(tag, m[3])
        outside = not opened.last("article") and not opened.last("main")
        node = _Node(tag, now, now.gone or gone or (tag == "header" and outside), hint, named)
        now.items.append(node)
        if tag in _CONTROLS and not node.gone:
            if opened.last("form"):
                node.gone = True
            else:
                controls.append(node)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        opened.push(node)
    prose: dict[int, bool] = {}
    for node in controls:  # a button or a label inside a run of prose is a word of it; others are controls of the page
        around = node.parent
        if id(around) not in prose:
            prose[id(around)] = any(isinstance(x, str) and x.strip() for x in around.items)
        node.gone = node.gone or not prose[id(around)]
    return body


def _order(body: _Node) -> list[_Node]:
    """Nodes that stay, parents first."""
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(x for x in n.items if not isinstance(x, str) and not x.gone)
    return out


def _measure(body: _Node) -> list[_Node]:
    nodes = _order(body)
    for n in reversed(nodes):
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(" ".join(x.split()))
            elif not x.gone:
                n.chars += x.chars
                n.tags += 1 + x.tags
                n.lchars += x.lchars
                n.ltags += x.ltags + (x.tag == "a")
        if n.tag == "a":
            n.lchars, n.ltags = n.chars, n.tags + 1
    c_body, l_body = max(body.chars, 1), body.lchars
    for n in nodes:
        if n.chars:
            c, t, lc, lt = n.chars, max(n.tags, 1), max(n.lchars, 1), max(n.ltags, 1)
            base = math.log(c / max(c - n.lchars, 1) * lc + l_body / c_body * c + math.e)
            # log with a base near 1 explodes; the base is at least ln(e) = 1, so it is held just above it
            n.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9) / math.log(max(base, 1.0001))
            n.density = max(n.density, 0.0)
    for n in nodes:
        n.total = sum(x.density for x in n.items if not isinstance(x, str) and not x.gone and (n.tag != "body" or x.tag not in _BLOCK or x.tag in _RUN))
        n.hint = n.hint or (n.parent is not None and n.parent.hint)  # parents come first
    return nodes


def _raised(n: _Node) -> _Node:
    while n.parent is not None and n.tag != "body" and (n.tag not in _BLOCK or n.tag in _RUN):
        n = n.parent
    return n


def _around(n: _Node, tags: tuple[str, ...]) -> _Node | None:
    """The nearest of these elements at or around ``n``."""
    while n is not None and n.tag not in tags:
        n = n.parent
    return n


def _chosen(body: _Node) -> tuple[list[_Node], float]:
    """The subtrees that hold the article, in page order, and the threshold."""
    nodes = _measure(body)
    best = max(nodes, key=lambda n: n.total * (NAMED if n.hint else 1.0), default=body)
    if best.total <= 0:  # no element has text in elements: what there is stands in the body or in single boxes
        best = max(nodes, key=lambda n: n.density * (NAMED if n.hint else 1.0))
        if any(isinstance(x, str) and x.strip() for x in body.items):
            best = body
    best = _raised(best)
    threshold, up = best.density, best.parent
    while up is not None and up.tag != "html":
        threshold = min(threshold, up.density)
        up = up.parent
    if (article := _around(best, ("article",))) is not None:
        return [article], threshold
    if best.tag == "body":
        return [body], threshold
    # other subtrees that are at least as dense as the thinnest node on the path hold content too
    out, todo = [], [_around(best, ("main",)) or body]
    path = set()
    up = best
    while up is not None:
        path.add(id(up))
        up = up.parent
    while todo:
        n = todo.pop()
        if n is best:
            out.append(n)
        elif id(n) in path:
            todo.extend(x for x in reversed(n.items) if not isinstance(x, str) and not x.gone)
        elif n.density >= threshold and n.chars and n.lchars * 2 <= n.chars and (best.hint or not n.hint) and n.tag != "form":
            out.append(n)
    return out, threshold


def _dropped(n: _Node, threshold: float, whole: int) -> bool:
    """Whether a box inside a chosen subtree is furniture: an advert, a notice or reader comments by name, named like furniture and thin, or a form of its own.

    Headings and list items never go by their names, and nothing goes for being a list of links.
    """
    if n.tag in _HEADINGS:
        return False
    if n.named in ("comments", "certain"):
        return n.chars * 2 < whole
    if n.named:
        return n.density < threshold
    return n.tag == "form" and n.chars * 2 < whole


def _blocks(top: _Node, threshold: float) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := " ".join(_html.unescape("".join(run)).split()):
                out.append(text)
            run.clear()

    todo: list = [(top, iter(top.items))]
    while todo:
        node, items = todo[-1]
        for x in items:
            if isinstance(x, str):
                run.append(x)
            elif x.gone:
                if x.tag in _BLOCK:
                    flush()
            elif x.tag in ("br", "wbr", "img"):
                run.append(" " if x.tag == "br" else "")
            elif x.tag in _BLOCK:
                flush()
                if not _dropped(x, threshold, top.chars):
                    todo.append((x, iter(x.items)))
                    break
            elif x.named and _dropped(x, threshold, top.chars):
                continue
            else:
                todo.append((x, iter(x.items)))
                break
        else:
            todo.pop()
            if node.tag in _BLOCK:
                flush()
    flush()
    return out


def main_text(page: str | None) -> str:
    """The page's main text: blocks joined by one newline; empty if there is none."""
    if not page:
        return ""
    tops, threshold = _chosen(parse(page))
    return "\n".join(b for top in tops for b in _blocks(top, threshold))


def _extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([main_text(x) for x in batch], dtype=object)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the column ``out`` added: the main text of the column ``html``."""
    bounded_batches(pages.sparkSession)
    run = F.pandas_udf(_extract, "string")
    return pages.withColumn(out, run(F.col(html)))
