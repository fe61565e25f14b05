"""Main text of web pages by composite text density.

The page becomes a tree of elements. What is never article text (scripts, menus, asides and the like, told by tag) leaves the
tree. Names and roles (adverts, comments, forms) are evidence only: a whole class or id must say so, headings and code are not
judged by them, and an element that holds most of the page's text stays. Each node's density is its characters per tag, damped by the share of its characters that
are links; a node's density sum adds its children's densities. The node with the largest sum is taken, or the article
that holds it. Without an article the least density on the node's path from the body is a threshold: elements beside the path
that reach it and are of a kind with the path's are parts of the article too. Nothing above ``main`` is looked at, and the body
is never taken as a whole.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMED = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# HTML element kinds.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_DROPPED = {"aside", "button", "canvas", "dialog", "footer", "head", "iframe", "input", "menu", "nav", "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
_TEXT = {"blockquote", "dl", "figure", "ol", "p", "pre", "table", "ul"}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "blockquote"}
# Words of class and id names, and roles, of what is no article text.
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "login",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets",
}


#: Words that may stand with the others in one name: "site-header", "comment-list".
_PLAIN = {"area", "bar", "block", "bottom", "box", "buttons", "container", "content", "global", "group", "inner", "item", "left", "links", "list", "main", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "top", "wrap", "wrapper"}
#: Kinds of doubt: none, doubtful by name, role or as a form, a header outside articles.
_FINE, _NAME, _HEADER = 0, 1, 2


def _doubtful(name: str) -> bool:
    """Whether a whole name says that it holds no article text."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return not _WORDS.isdisjoint(parts) and all(x in _WORDS or x in _PLAIN for x in parts)


class _Page:
    """Nodes in page order (node 0 is the root) and the text pieces and block bounds between their tags."""

    def __init__(self, source: str):
        self.parent, self.tag = [-1], [""]
        self.gone, self.link, self.article = [False], [False], [False]
        self.kind, self.doubt, self.code = [""], [_FINE], [False]  # kind: class names
        self.pieces: list[tuple[int, str | None]] = []  # None: a block begins or ends
        open_nodes, at = [0], 0
        match = _TOKEN.search(source)
        while match:
            if match.start() > at:
                self._text(open_nodes[-1], source[at : match.start()])
            at = match.end()
            if match[2]:
                tag = match[2].lower()
                if match[1]:
                    self._close(open_nodes, tag)
                elif tag in _RAW:
                    end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                else:
                    self._open(open_nodes, tag, match[3])
            match = _TOKEN.search(source, at)
        self._text(open_nodes[-1], source[at:])

    def _text(self, node: int, text: str) -> None:
        if text and not self.gone[node]:
            self.pieces.append((node, html.unescape(text) if "&" in text else text))

    def _open(self, open_nodes: list[int], tag: str, attributes: str) -> None:
        if tag in _BLOCK and tag not in ("html", "body"):
            self._shut(open_nodes, {"p"})
        if tag in _CLOSES:
            self._shut(open_nodes, _CLOSES[tag])
        up = open_nodes[-1]
        if tag in _BLOCK:
            self.pieces.append((up, None))
        if tag == "br":
            self._text(up, " ")
        self.parent.append(up)
        self.tag.append(tag)
        self.article.append(self.article[up] or tag in ("article", "main"))
        kind, names, hidden, doubt = "", [], False, _NAME if tag == "form" else _FINE
        for m in _NAMED.finditer(attributes) if attributes else ():
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = tag not in ("html", "body")
            elif name == "role" and value.strip() in _ROLES:
                doubt = _NAME
            elif name == "class" or name == "id":
                kind = value if name == "class" else kind
                names += value.split()
        if tag == "header" and not self.article[up]:
            doubt = _HEADER
        skip = {"header", "banner"} if tag == "header" or self.article[up] else ()
        if tag not in _HEADINGS and not self.code[up] and any(x not in skip and _doubtful(x) for x in names):
            doubt = _NAME
        self.kind.append(kind)
        self.doubt.append(_FINE if tag in ("html", "body", "main") else doubt)
        self.code.append(self.code[up] or tag in ("code", "pre"))
        self.gone.append(self.gone[up] or hidden or tag in _DROPPED)
        self.link.append(self.link[up] or tag == "a")
        if tag not in _VOID and not attributes.endswith("/"):
            open_nodes.append(len(self.tag) - 1)

    def _shut(self, open_nodes: list[int], tags: set[str]) -> None:
        """End the nearest open element of ``tags``, unless another block holds the place."""
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = self.tag[open_nodes[k]]
            if tag in tags:
                self.pieces.append((open_nodes[k], None))
                del open_nodes[k:]
                return
            if tag in _SCOPE:
                return

    def _close(self, open_nodes: list[int], tag: str) -> None:
        for k in range(len(open_nodes) - 1, 0, -1):
            if self.tag[open_nodes[k]] == tag:
                if tag in _BLOCK:
                    self.pieces.append((open_nodes[k], None))
                del open_nodes[k:]
                return

    def _settle(self) -> None:
        """Doubtful elements go, but for those that hold most of the text and for headers of a title alone."""
        n = len(self.tag)
        if not any(self.doubt):
            return
        chars, links, last = [0] * n, [0] * n, list(range(n))
        own, titles, menus = [0] * n, [0] * n, [0] * n
        for node, text in self.pieces:
            if text:
                chars[node] += len(text.strip())
                links[node] += len(text.strip()) * self.link[node]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            last[up] = max(last[up], last[i])
            own[up] += own[i] + (self.tag[i] in ("h1", "main", "article") and not self.doubt[i])
            titles[up] += titles[i] + (self.tag[i] in _HEADINGS)
            menus[up] += menus[i] + (self.tag[i] == "nav")
            if not self.gone[i]:
                chars[up] += chars[i]
                links[up] += links[i]
        i = 1
        while i < n:
            if self.doubt[i] == _NAME:
                goes = 2 * chars[i] <= chars[0] if own[i] else 4 * chars[i] <= 3 * chars[0]
            elif self.doubt[i] == _HEADER:
                goes = self.tag[self.parent[i]] in ("body", "html", "") or 2 * links[i] > chars[i] or not titles[i] or menus[i] > 0
            else:
                goes = False
            if goes:
                for k in range(i, last[i] + 1):
                    self.gone[k] = True
                i = last[i]
            i += 1

    def chosen(self) -> list[tuple[int, int]]:
        """First and last node of each part of the tree that the article is made of."""
        self._settle()
        n = len(self.tag)
        chars, links, tags, link_tags, last = [0] * n, [0] * n, [0] * n, [0] * n, list(range(n))
        for node, text in self.pieces:
            if text and not self.gone[node]:
                size = len(text.strip())
                chars[node] += size
                links[node] += size * self.link[node]
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            last[up] = max(last[up], last[i])
            if not self.gone[i]:
                chars[up] += chars[i]
                links[up] += links[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        density, total = [0.0] * n, [0.0] * n
        share = links[body] / max(1, chars[body])
        for i in range(n - 1, -1, -1):
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, links[i]), max(1, link_tags[i])
            if c and not self.gone[i]:
                base = math.log(c / max(1, c - links[i]) * links[i] + share * c + math.e)
                density[i] = c / t * max(0.0, math.log(c / lc * t / lt)) / max(1.0, math.log(base) if base > math.e else 1.0)
                if i:
                    total[self.parent[i]] += density[i]
        best = max(range(body, n), key=lambda i: (total[i], -i)) if any(total) else body
        path = [best]
        while path[-1] > body:
            path.append(self.parent[path[-1]])
        articles = [i for i in path if self.tag[i] == "article"]
        below, i = [], best + 1
        while i <= last[best]:
            if self.tag[i] == "article" and not self.gone[i]:
                below.append(i)
                i = last[i]
            i += 1
        if not articles and len(below) == 1:
            articles = below
        if articles:  # articles inside an article belong to it
            return [(articles[-1], last[articles[-1]])]
        inside: list[list[int]] = [[] for _ in range(n)]
        for i in range(body + 1, n):
            if not self.gone[i]:
                inside[self.parent[i]].append(i)
        threshold = min(density[i] for i in path)
        whole = best == body or self.tag[best] == "main"
        dense = max(inside[best], key=lambda i: density[i], default=best)
        strict = whole or self.tag[dense] not in _TEXT
        spans = [(best, best)]
        for i in inside[best]:
            if self.tag[i] in _BLOCK - _HEADINGS - {"p"}:
                if 2 * links[i] > chars[i] or strict and density[i] < threshold and self.tag[i] not in _TEXT and not self._alike(i, dense, whole):
                    continue
            spans.append((i, last[i]))
        if whole:
            return spans
        taken, titled = [], any(self.tag[i] == "h1" for i in range(best, last[best] + 1))
        for node, up in zip(path, path[1:]):  # what stands beside the path and is as dense as the path itself
            edge = up == body or self.tag[up] == "main"
            group, at = inside[up], inside[up].index(node)
            like = [i == node or density[i] >= threshold and self._alike(i, node, edge) for i in group]
            low, high = like.index(True), len(like) - 1 - like[::-1].index(True)
            while low and self.tag[group[low - 1]] in _HEADINGS and 2 * links[group[low - 1]] <= chars[group[low - 1]]:
                low -= 1
            taken += [i for k, i in enumerate(group[low : high + 1], low) if k != at and (like[k] or self.tag[i] in _HEADINGS)]
            title = [i for i in group[:at] if self.tag[i] in ("h1", "hgroup", "header") and 2 * links[i] <= chars[i] and i not in taken]
            if title and not titled and not any(self.tag[i] == "h1" for i in taken):
                taken.append(title[-1])
            titled = titled or any(self.tag[i] in ("h1", "hgroup", "header") for i in taken)
            if edge:
                break
        return spans + [(i, last[i]) for i in taken]

    def _alike(self, node: int, other: int, edge: bool) -> bool:
        """Parts of one article: sections, elements of one kind and class, and inside a wrapper also plain text blocks."""
        if self.tag[node] == "section" and self.tag[other] == "section" or self.tag[node] == self.tag[other] and self.kind[node] == self.kind[other] and (self.kind[node] or not edge):
            return True
        return not edge and (self.tag[node] in _TEXT or self.tag[node] == "section")


def main_text(source: str | None) -> str:
    """The article's blocks, white space folded, joined by a blank line; empty for a null, blank or textless page."""
    if not source:
        return ""
    page = _Page(source)
    inside = bytearray(len(page.tag))
    for first, final in page.chosen():
        inside[first : final + 1] = b"\1" * (final + 1 - first)
    blocks, held = [], []
    for node, text in page.pieces:
        if text is None or inside[node] and not page.gone[node]:
            if text is None:
                block = " ".join("".join(held).split())
                held = []
                if block:
                    blocks.append(block)
            else:
                held.append(text)
    block = " ".join("".join(held).split())
    return "\n\n".join([*blocks, block] if block else blocks)


def _extract(batches):
    for part in C.chunks(batches, "html"):
        text = [main_text(x) for x in part.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). A null html is an empty page; null ids and urls are kept.

    Rows that repeat give equal rows. Only page_id, url and html are read, so other columns may have any names. An empty table
    gives an empty result.
    """
    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(C.table(spark, sf_dir, "pages"))
