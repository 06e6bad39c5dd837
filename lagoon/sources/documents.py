"""Articles and filings from HTML columns: metadata and prose, by one linear scan of each page."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that are no part of an article, and where an article is looked for.
SILENT_TAGS = ["script", "style", "noscript", "svg"]
DROPPED_TAGS = [*SILENT_TAGS, "nav", "footer", "form", "aside"]
DROPPED_ROLES = ["navigation", "complementary"]
DROPPED_CLASSES = ["advert", "newsletter", "subscribe", "related", "recommend", "social", "share", "comment", "cookie"]
DROPPED_IDS = ["advert", "newsletter", "subscribe", "related", "comment", "cookie"]
ARTICLE_TAGS = ["article", "main"]
ARTICLE_CLASSES = ["article-body", "article__body", "story-body", "story__body", "entry-content", "post-content"]
TITLE_KEYS, AUTHOR_KEYS, DATE_KEYS = ["og:title", "twitter:title"], ["author", "article:author", "byl"], ["article:published_time", "datePublished", "date"]

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An element of the key ends an open one of the first set, unless one of the second lies between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _is_dropped(tag: str, attrs: dict[str, str]) -> bool:
    low = {k: attrs.get(k, "").lower() for k in ("class", "id", "aria-label")}
    return (
        tag in DROPPED_TAGS
        or attrs.get("role") in DROPPED_ROLES
        or "advertisement" in low["aria-label"]
        or any(s in low["class"] for s in DROPPED_CLASSES)
        or any(s in low["id"] for s in DROPPED_IDS)
    )


class Page(HTMLParser):
    """A page's elements in document order, each with the range of elements and of text pieces within it.

    Left-out ends of p, li, tr, td and th are filled in, ends without a start skipped. Time and memory are linear.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.silent: list[bool] = []  # within an element without visible text
        self.dropped: list[bool] = []  # within an element that is no part of an article
        self.ends: list[int] = []
        self.first_piece: list[int] = []
        self.end_piece: list[int] = []
        self.pieces: list[tuple[str, bool, bool]] = []
        self._open: list[int] = []
        self._count: Counter = Counter()
        complete = html.rfind(">") + 1  # behind the last tag's end no tag can end: there a < is text, and is not scanned again and again
        self.feed(html[:complete] + html[complete:].replace("<", "&lt;"))
        self.close()
        self._close_to(0)

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            i = self._open.pop()
            self._count[self.tags[i]] -= 1
            self.ends[i], self.end_piece[i] = len(self.tags), len(self.pieces)

    def _close_last(self, names: Sequence[str], within: Sequence[str] = ()) -> None:
        if any(self._count[n] for n in names):
            for depth in range(len(self._open) - 1, -1, -1):
                tag = self.tags[self._open[depth]]
                if tag in names:
                    self._close_to(depth)
                    return
                if tag in within:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH:
            self._close_last(("p",), ("td", "th", "table"))
        if tag in ENDS:
            self._close_last(*ENDS[tag])
        own = {k: v or "" for k, v in reversed(attrs)}
        above = self._open[-1] if self._open else None
        self.silent.append(tag in SILENT_TAGS or (above is not None and self.silent[above]))
        self.dropped.append(_is_dropped(tag, own) or (above is not None and self.dropped[above]))
        self.tags.append(tag)
        self.attrs.append(own)
        self.first_piece.append(len(self.pieces))
        self.ends.append(len(self.tags))
        self.end_piece.append(len(self.pieces))
        if tag not in VOID:
            self._open.append(len(self.tags) - 1)
            self._count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_to(len(self._open) - 1)

    def handle_endtag(self, tag: str) -> None:
        self._close_last((tag,))

    def handle_data(self, data: str) -> None:
        if piece := " ".join(data.split()):
            i = self._open[-1] if self._open else None
            self.pieces.append((piece, i is not None and self.silent[i], i is not None and self.dropped[i]))

    def text(self, i: int, article: bool) -> str:
        """Text of an element without silent pieces or, for an article, without dropped ones."""
        return " ".join(t for t, silent, dropped in self.pieces[self.first_piece[i] : self.end_piece[i]] if not (dropped if article else silent))

    def of(self, *tags: str) -> Iterator[int]:
        return (i for i, t in enumerate(self.tags) if t in tags)

    def meta(self, keys: Sequence[str]) -> str | None:
        """Content of the first meta element of the first key that has one, by property or else by name."""
        for key in keys:
            for attr in ("property", "name"):
                i = next((i for i in self.of("meta") if self.attrs[i].get(attr) == key), None)
                if i is not None and (content := " ".join(self.attrs[i].get("content", "").split())):
                    return content
        return None

    def title(self) -> str | None:
        return next((t for i in self.of("title") if (t := " ".join(p for p, *_ in self.pieces[self.first_piece[i] : self.end_piece[i]]))), None)


def article_fields(html: str | None) -> tuple[str | None, str | None, str | None, str | None, str | None]:
    """(title, author, published_at, language, text) of a page; NULL for what it lacks.

    The text is the paragraphs of 25 characters or more of that article element which has most of them, or of
    the whole page if there is none; menus, forms, adverts, comments and the like are left out.
    """
    page = Page(html or "")
    paragraphs = [(i, t) for i in page.of("p") if not page.dropped[i] and len(t := page.text(i, True)) >= 25]
    at = [i for i, _ in paragraphs]
    sums = [0, *accumulate(len(t) for _, t in paragraphs)]
    best: tuple[int, int, int] | None = None
    for i, (tag, attrs) in enumerate(zip(page.tags, page.attrs, strict=True)):
        if not page.dropped[i] and (tag in ARTICLE_TAGS or attrs.get("itemprop") == "articleBody" or any(c in ARTICLE_CLASSES for c in attrs.get("class", "").split())):
            a, b = bisect_left(at, i), bisect_left(at, page.ends[i])
            if best is None or sums[b] - sums[a] > best[0]:
                best = (sums[b] - sums[a], a, b)
    _, a, b = best or (0, 0, len(paragraphs))
    text = "\n\n".join(t for _, t in paragraphs[a:b])
    language = next((v for i in page.of("html") if (v := page.attrs[i].get("lang"))), None)
    return page.meta(TITLE_KEYS) or page.title(), page.meta(AUTHOR_KEYS), page.meta(DATE_KEYS), language, text or None


def notice(most: int) -> str:
    return f"\n\n[TEXT CUT AFTER {most:,} CHARACTERS]"


def plain_filing(page: Page, most: int) -> str:
    """Paragraphs and list items, then the rows of innermost tables, each text once; else the lines of the page.

    Longer texts than `most` characters are cut there and say so.
    """

    def blocks() -> Iterator[str]:
        some = False
        for i in page.of("p", "li"):
            if not page.silent[i] and len(t := page.text(i, False)) >= 25:
                some = True
                yield t
        holds_row = {j for j in _row_parents(page)}
        for i in page.of("tr"):
            if i not in holds_row and not page.silent[i] and len(t := page.text(i, False)) >= 10:
                some = True
                yield t
        if not some:
            yield from (t for t, silent, _ in page.pieces if not silent and len(t) >= 2)

    out: list[str] = []
    seen: set[str] = set()
    used = 0
    for t in blocks():
        if (form := t.casefold()) in seen:
            continue
        if used + len(t) > most:
            return "\n\n".join([*out, t[: max(0, most - used)]])[:most] + notice(most)
        seen.add(form)
        out.append(t)
        used += len(t) + 2
    return "\n\n".join(out)


def _row_parents(page: Page) -> Iterator[int]:
    """Rows with a row inside."""
    rows = list(page.of("tr"))
    return (i for i, j in zip(rows, rows[1:], strict=False) if j < page.ends[i])


def filing_fields(html: str | None, description: str | None = None, most: int = 50_000, large: int = 1_000_000) -> tuple[str | None, str | None]:
    """(text, title) of a filing's document: its article, or all its prose and table rows.

    The latter for documents of `large` bytes or more, for articles under 300 characters that it is longer
    than, and for articles over `most` or 20 times the document. `most` characters are kept, with a notice if
    there were more. Without a title the description is it.
    """
    html = html or ""
    size = len(html.encode("utf-8", "replace"))
    if size >= large:
        page = Page(html)
        title, text = page.title(), plain_filing(page, most)
    else:
        title, _, _, _, found = article_fields(html)
        text = found or ""
        bloated = len(text) > min(most, max(200_000, 20 * size))
        if len(text) < 300 or bloated:
            plain = plain_filing(Page(html), most)
            text = plain if bloated or len(plain) > len(text) else text
    return text or None, title or ((description or "").strip() or None)


def _extracted(df: DataFrame, key: str, columns: Sequence[str], fields: Sequence[str], make: Callable[..., tuple]) -> DataFrame:
    kind = T.StructType([df.schema[key], *[T.StructField(f, T.StringType()) for f in fields]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            given = zip(*(pdf[f"__{i}"] for i in range(len(columns))), strict=True)
            yield pd.DataFrame([(k, *make(*row)) for k, row in zip(pdf["__key"], given, strict=True)], columns=[key, *fields])

    slim = df.select(F.col(key).alias("__key"), *[F.col(c).cast("string").alias(f"__{i}") for i, c in enumerate(columns)])
    return slim.mapInPandas(run, kind)


def extract_articles(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, author, published_at, language, text): `article_fields` of every row."""
    return _extracted(df, key, [html], ["title", "author", "published_at", "language", "text"], article_fields)


def extract_filings(df: DataFrame, key: str, html: str, description: str | None = None, most: int = 50_000) -> DataFrame:
    """(key, text, title): `filing_fields` of every row."""
    columns = [html] if description is None else [html, description]
    return _extracted(df, key, columns, ["text", "title"], lambda page, about=None: filing_fields(page, about, most))
