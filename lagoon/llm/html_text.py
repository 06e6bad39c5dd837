"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A linear classifier gives each block a cost for being called content and
one for boilerplate: the capacities of its edges to the terminals. Neighbouring blocks, the nearer in the
document tree the more, are joined by smoothness edges. The blocks on the source's side of a minimum cut
are the content.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.common import row_slices, text_or_empty

TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
TAG_STOP = re.compile(r"""[>"']""")
#: Text inside these is no text of the page.
SILENT = frozenset(["script", "style", "noscript", "template", "svg", "iframe", "select", "textarea", "title", "canvas", "audio", "video"])
BREAKS = frozenset(["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre", "blockquote", "section", "article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "legend", "figure", "figcaption", "address", "details", "summary", "hr", "body", "html", "head", "menu", "dialog", "center", "hgroup", "search", "button"])
VOID = frozenset(["hr", "br", "img", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "track", "param"])
#: A start tag of the key closes an open element of these.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: How much an element speaks for content (above 0) or boilerplate (below 0).
TAG_SIGNAL = {"article": 4.0, "main": 3.0, "nav": -6.0, "footer": -6.0, "aside": -5.0, "form": -5.0, "header": -3.0, "menu": -6.0, "dialog": -6.0, "button": -5.0, "fieldset": -4.0, "figcaption": -0.5, "search": -5.0, "address": -1.0}
NAME_SIGNAL = {
    4.0: "article articlebody articletext content maincontent entry post story hentry postbody bodytext",
    2.0: "main body text page prose",
    -3.0: "header masthead widget meta tags byline toolbar pagination pager related recommended promo",
    -6.0: "ad ads advert adverts advertisement advertising banner sponsor sponsored cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer copyright comment comments commentlist disqus reply replies respond share sharing social follow related-posts skip hidden hide print toc search form feedback paywall alert",
}
ROLE_SIGNAL = {"main": 3.0, "article": 4.0, "navigation": -6.0, "banner": -5.0, "complementary": -5.0, "contentinfo": -6.0, "search": -6.0, "dialog": -6.0, "alert": -6.0, "form": -5.0, "menu": -6.0}
NAMES = {n: v for v, names in NAME_SIGNAL.items() for n in names.split()}
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NOTICE = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
ADJACENT, RELATED = 0.8, 1.2


@lru_cache(maxsize=20_000)
def element_signal(tag: str, attributes: str) -> float:
    """What a start tag says; the strongest of its names, role and tag."""
    found = [TAG_SIGNAL.get(tag, 0.0)]
    if attributes.strip():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                parts = [p.lower() for p in NAME_PART.findall(value)]
                found += [NAMES[p] for p in parts if p in NAMES]
                found += [NAMES[w] for w in value.lower().split() if w in NAMES]
            elif name == "role":
                found.append(ROLE_SIGNAL.get(value.lower(), 0.0))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                found.append(-6.0)
    return min(found) if min(found) < 0 else max(found)


@dataclass
class Block:
    text: str
    tag: str
    node: int  # of the innermost open element; 0 is the page
    signal: float
    linked: int


@dataclass
class Tree:
    """Parent and depth of each element that breaks the text, by number; 0 is the page itself."""

    parent: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def steps(self, a: int, b: int, most: int = 64) -> int:
        """Edges between two elements; counted up to about `most`, beyond which nearness is nil."""
        steps = 0
        while a != b and steps < most:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            steps += 1
        return steps


class Markup:
    """The page's tags one after another, each character looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html = html
        self.last_close = html.rfind(">")
        self.without_end: set[str] = set()  # elements that nothing closes from here on

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at `at`; quoted values may hold others."""
        pos = at
        while m := TAG_STOP.search(self.html, pos):
            if m[0] == ">":
                return m.start()
            pos = m.end()
            if self.html[at : m.start()].rstrip().endswith("=") if m.start() - at < 200 else self.html[m.start() - 1] in "= \t\r\n":
                closed = self.html.find(m[0], pos)
                pos = closed + 1 if closed >= 0 else pos
        return self.html.find(">", at)

    def next_tag(self, at: int) -> tuple[int, int, bool, str, str]:
        """(begin, end, closes, name, attributes) of the next markup from `at`; no name for comments and the like."""
        html, size = self.html, len(self.html)
        while 0 <= (begin := html.find("<", at)):
            if html.startswith("<!--", begin):
                ends = [e + n for e, n in ((html.find("-->", begin + 4), 3), (html.find("--!>", begin + 4), 4)) if e >= 0] if begin < self.last_close else []
                return begin, min(ends, default=size), False, "", ""
            if begin > self.last_close:  # no tag ends any more
                break
            if m := TAG_NAME.match(html, begin + 1):
                end = self.tag_end(m.end())
                return begin, end + 1, bool(m[1]), m[2].lower(), html[m.end() : end]
            if html[begin + 1 : begin + 2] in ("!", "?", "/"):
                return begin, html.find(">", begin) + 1, False, "", ""
            at = begin + 1
        return size, size, False, "", ""

    def after(self, tag: str, at: int) -> int:
        """Where the element that begins at `at` and whose text is not read ends; `at` if nothing closes it."""
        if tag not in self.without_end:
            if close := closing(tag).search(self.html, at):
                return close.end()
            self.without_end.add(tag)
        return len(self.html) if tag in ("script", "style", "textarea", "title") else at


@lru_cache(maxsize=64)
def closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*+(?:>|\Z)", re.I)


def blocks(html: str) -> tuple[list[Block], Tree]:
    """The page's text blocks in order; tolerant of what is unclosed, and of what is closed but not open."""
    out: list[Block] = []
    tree, markup = Tree(), Markup(html)
    stack: list[tuple[str, int, float]] = [("", 0, 0.0)]  # tag, number, signal from here down
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links: list[int] = []  # of the parts, those inside a link
    in_link, at, size = False, 0, len(html)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            in_links = sum(len(parts[i]) for i in links)
            out.append(Block(text, stack[-1][0], stack[-1][1], stack[-1][2], min(in_links, len(text))))
        parts.clear()
        links.clear()

    def leave() -> None:
        open_tags[stack.pop()[0]] -= 1

    while at < size:
        begin, end, closes, tag, attributes = markup.next_tag(at)
        if begin > at:
            if in_link:
                links.append(len(parts))
            parts.append(html[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if tag == "a":
                in_link = False
            elif tag in BREAKS:
                flush()
                if open_tags[tag]:
                    while stack[-1][0] != tag:
                        leave()
                    leave()
            continue
        if tag in SILENT:
            if not attributes.rstrip().endswith("/"):
                at = markup.after(tag, at)
            parts.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in BREAKS:
            flush()
            implied = CLOSES.get(tag, {"p"})
            while stack[-1][0] in implied and tag not in ("html", "body", "head"):
                leave()
            if tag not in VOID:
                own, above = element_signal(tag, attributes), stack[-1][2]
                stack.append((tag, tree.add(stack[-1][1]), own + 0.5 * above if own else above))
                open_tags[tag] += 1
        elif tag in VOID:
            parts.append(" ")
    flush()
    return out, tree


def content_odds(b: Block) -> float:
    """Log-odds of being content, by fixed weights."""
    words = b.text.count(" ") + 1
    odds = -1.6 + 0.7 * log(words) + b.signal
    odds -= 3.0 * b.linked / max(1, len(b.text))
    if b.text[-1] in ".!?:;…\"'”»)。！？":
        odds += 0.6
    if b.tag in ("p", "blockquote", "pre"):
        odds += 0.8
    elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += 0.5
    if words <= 12 and NOTICE.match(b.text):
        odds -= 2.0
    return odds


def smoothness(steps: int) -> float:
    """Joint capacity of two neighbours: a constant, and more the fewer steps lie between them in the tree."""
    return ADJACENT / (1 + steps) + (RELATED / steps if 0 < steps <= 2 else RELATED if steps == 0 else 0.0)


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut.

    Positive odds are capacity from the source, negative ones to the sink; edges have their capacity both
    ways. Maximum flow by shortest augmenting paths in levels.
    """
    n = len(odds)
    source, sink = n, n + 1
    if all(o > 0 for o in odds):
        return [True] * n
    if all(o <= 0 for o in odds):
        return [False] * n
    graph: list[list[list]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: float, back: float) -> None:
        graph[u].append([v, there, len(graph[v])])
        graph[v].append([u, back, len(graph[u]) - 1])

    for i, o in enumerate(odds):
        if o > 0:
            join(source, i, o, 0.0)
        elif o < 0:
            join(i, sink, -o, 0.0)
    for u, v, c in edges:
        join(u, v, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c, _ in graph[u]:
                if c > tiny and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[list] = []
        u = source
        while True:
            if u == sink:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                keep = next(i for i, e in enumerate(path) if e[1] <= tiny)
                u = graph[path[keep][0]][path[keep][2]][0]
                del path[keep:]
                continue
            row = graph[u]
            while tried[u] < len(row):
                e = row[tried[u]]
                if e[1] > tiny and level[e[0]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(row):
                path.append(row[tried[u]])
                u = row[tried[u]][0]
            elif path:
                level[u] = -1
                e = path.pop()
                u = graph[e[0]][e[2]][0]
            else:
                break


def content_blocks(found: list[Block], tree: Tree) -> list[bool]:
    """Which blocks are content: by the cut, or, if it leaves none, those that nothing speaks against.

    A page may be so short that no block has words enough to be called content by the classifier.
    """
    odds = [content_odds(b) for b in found]
    edges = [(i, i + 1, smoothness(tree.steps(found[i].node, found[i + 1].node))) for i in range(len(found) - 1)]
    last_under: dict[int, int] = {}
    for i, b in enumerate(found):  # siblings with other blocks between them
        before = last_under.get(tree.parent[b.node], -1)
        if 0 <= before < i - 1:
            edges.append((before, i, RELATED / 2))
        last_under[tree.parent[b.node]] = i
    kept = minimum_cut(odds, edges)
    if any(kept):
        return kept
    return [b.signal >= 0 and 2 * b.linked <= len(b.text) and not NOTICE.match(b.text) for b in found]


def main_text(html: str) -> str:
    """The content blocks in page order, two line feeds between."""
    found, tree = blocks(html)
    return "\n\n".join(b.text for b, keep in zip(found, content_blocks(found, tree), strict=True) if keep) if found else ""


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: the id, url, text, n_chars (code points).

    A null html is empty and gives an empty text. Repeated rows and null ids and urls stay; an empty table
    gives an empty result; other columns are not read. Whole pages are parsed, in time and memory that grow with their size.
    Where the cut calls nothing content, the blocks that nothing speaks against are the text. One pass,
    no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, rows=256, text=2):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    kinds = T.StructType([*slim.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return slim.mapInArrow(run, kinds).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
