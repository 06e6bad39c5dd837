"""Text operators: normal forms, quality, exact and near parents, boilerplate, cleaning, chunking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.operators.aggs import frequent_edges
from lagoon.operators.joins import band_classes, band_pairs


def words(x: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_hash(x: Column | str) -> Column:
    """sha256 of the words, single-spaced."""
    return F.sha2(F.array_join(words(x), " "), 256)


def paragraph_key(x: Column | str) -> Column:
    """A paragraph's form for comparison: its words in lower case, without links and numbers."""
    x = F.regexp_replace(F.lower(x), r"https?://\S+", "")
    x = F.regexp_replace(x, r"\p{Nd}+", "#")
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " "))


def domain(url: Column | str) -> Column:
    """Host in lower case without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def clean_title(x: Column | str) -> Column:
    """Up to the first spaced bar."""
    return F.trim(F.split(x, r" \| ")[0])


def redact(x: Column | str) -> Column:
    """Credentials in URLs and key=value secrets masked."""
    x = F.regexp_replace(x, r"(?i)((?:api_?key|apikey|token|secret|password)=)[^&\s]+", "$1***")
    return F.regexp_replace(x, r"(://)[^/@\s:]+:[^/@\s]+@", "$1***@")


def first_category(x: Column | str, keywords: dict[str, Sequence[str]], default: str = "other") -> Column:
    """The first category of which a keyword occurs."""
    low, out = F.lower(x), None
    for name, some in keywords.items():
        cond = low.rlike("|".join(re.escape(k) for k in some))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def text_metrics(x: Column | str) -> dict[str, Column]:
    """Counts of characters, words, numbers, currency amounts and percentages."""
    return {
        "chars": F.length(x).cast("bigint"),
        "words": F.size(words(x)).cast("bigint"),
        "numbers": F.regexp_count(x, F.lit(r"[0-9]+(?:[.,][0-9]+)*")).cast("bigint"),
        "currency": F.regexp_count(x, F.lit(r"[$€£][0-9]")).cast("bigint"),
        "percent": F.regexp_count(x, F.lit(r"[0-9]%")).cast("bigint"),
    }


def lexicon_counts(x: Column | str, lexicons: dict[str, Sequence[str]]) -> dict[str, Column]:
    """Occurrences of each lexicon's words as whole tokens."""
    toks = words(x)

    def hits(some: Sequence[str]) -> Column:
        return F.size(F.filter(toks, lambda t: t.isin(list(some)))).cast("bigint")

    return {name: hits(some) for name, some in lexicons.items()}


def exact_parents(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Rows with canonical: the least key of the same digest, NULL for that row itself.

    The least keys come from an aggregation with map-side combination; a digest that a third of all rows
    share is one row there, and AQE splits its side of the join.
    """
    d = df.withColumn("__h", digest)
    least = d.groupBy("__h").agg(F.min(key).alias("__least"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    out = d.join(least, "__h", "left")
    return out.withColumn("canonical", F.when(F.col("__least") < F.col(key), F.col("__least"))).drop("__h", "__least")


def simhashes(df: DataFrame, key: str, shingles: Column, name: str = "fingerprint", bits: int = 64) -> DataFrame:
    """(key, fingerprint): the majority vote of the bits of 64-bit shingle hashes, as a long; a tie is 0.

    Hashes are exploded and each bit is a sum with map-side combination, in generated code.
    """
    each = df.select(key, F.explode_outer(shingles).alias("__s")).select(key, F.xxhash64("__s").alias("__h"))
    votes = each.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.getbit("__h", F.lit(b)).cast("bigint")).alias(f"__b{b}") for b in range(bits)])
    fp = F.lit(0).cast("bigint")
    for b in range(bits):
        fp = fp.bitwiseOR(F.when(2 * F.col(f"__b{b}") > F.col("__n"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return votes.select(key, fp.alias(name))


def word_shingles(w: Column | str, n: int = 4) -> Column:
    """Runs of n words of an array of words; all of them as one, if there are fewer."""
    w = F.col(w) if isinstance(w, str) else w
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array(F.array_join(w, " ")))


def canonical_roots(df: DataFrame, key: str, digest: Column, fingerprint: str, size: str, eligible: Column, radius: int = 3, least_ratio: float = 0.85, rounds: int = 30, candidate: Column | None = None) -> DataFrame:
    """(key, parent, root): the parent is the least earlier exact copy, else, for eligible rows, the least
    earlier candidate that is a near-duplicate, equal fingerprints included; the root is where parents end.

    candidate: rows that can be near parents, all eligible ones among them; the eligible ones if not given.

    Only lower keys can be parents, so it is a forest: pointer jumping halves the depth each round.
    Closing the pairs transitively would merge more. Copies of one fingerprint are compared once.
    """
    exact = exact_parents(df.select(key, digest.alias("__d")), key, F.col("__d")).select(key, F.col("canonical").alias("__e"))
    some = df.where(eligible if candidate is None else candidate)
    near = band_pairs(some, key, fingerprint, size, 4, radius, least_ratio).groupBy(F.col(key).alias("representative")).agg(F.min("lower").alias("__lower"))
    # a row's near keys below it are its representative and what that one is near
    near = band_classes(some, key, fingerprint, size).join(near, "representative", "left").select(key, F.least("__lower", F.when(F.col("representative") < F.col(key), F.col("representative"))).alias("__n"))
    near = near.where("__n is not null").join(df.where(eligible).select(key), key, "left_semi")
    links = exact.join(near, key, "left").select(key, F.coalesce("__e", "__n").alias("parent"))
    state = links.withColumn("root", F.coalesce("parent", key)).checkpoint()
    for _ in range(rounds):
        up = state.select(F.col(key).alias("__k"), F.col("root").alias("__up"))
        new = state.join(up, F.col("root") == F.col("__k")).select(key, "parent", F.col("__up").alias("root"), (F.col("root") != F.col("__up")).alias("__moved")).checkpoint()
        moved = new.where("__moved").limit(1).count()
        state = new.drop("__moved")
        if not moved:
            return state
    raise RuntimeError(f"roots did not settle in {rounds} rounds")


# What marks a paragraph as furniture of a page, the head of a promotional tail, a credit, a byline,
# a note on the author; and titles that say nothing.
FURNITURE = [
    r"^(sign up|subscribe)\b.*(newsletter|updates?|news)",
    r"^(already|not yet) (a )?subscriber\b",
    r"^(log in|sign in|register)( to| for)?\b",
    r"^(read|click|tap) (more|here)\b",
    r"^(share|print|save) (this|the) (article|story)\b",
    r"^follow (us|the .*?) on (facebook|twitter|x|instagram|youtube)\b",
    r"^follow .{1,100} on (facebook|twitter|x|instagram|youtube)\b",
    r"^(recommended|related|more) (stories|articles|content)\b",
    r"^comments? (have|must|are|will)\b",
    r"^(privacy policy|terms (of use|and conditions)|cookie settings)$",
    r"^get (the )?(editor'?s|latest|top|breaking)\b.*(newsletter|insights?|news)",
    r"^stay in the know\b",
    r"^klix\.ba čitajte i u našoj aplikaciji\b",
    r"^this article originally appeared on\b",
    r"^contributing:\s+",
    r"^photo\s*:\s*.+(?:getty|images?|ap|reuters)\b",
    r"^check all issues\s*&\s*supplements\.?$",
    r"^article continues below (this )?ad\.?$",
    r"^currently receiving \d+ of \d+ possible notifications\b",
    r"^sorry we are not currently accepting comments\b",
    r"^[_\-–—]{8,}$",
    r"^©.*all rights reserved\.?$",
]
TAIL_HEADS = [
    r"^be the first to know when news breaks\.?$",
    r"^today'?s top stories curated by our news team\.?$",
    r"^your digital replica of today'?s paper\b",
    r"^sharp\. close to the ground\. digging deep\.",
    r"^every saturday and tuesday, explore destinations\b",
    r"^your essential national news digest\b",
    r"^get news, reviews and expert insights every thursday\b",
    r"^real local, smart property news\b",
    r"^test your skills with interactive crosswords\b",
    r"^temi più discussi\s*:",
]
CREDIT = r"^(australian associated press|associated press|reuters|afp|copyright .+|.{2,100},\s*the associated press)$"
BYLINE = r"^(?:by\s+)[\w .,'’\-]{2,100}$"
AUTHOR_NOTE = r"\b(is (a|an) (writer|reporter|editor)|follow (him|her|them) on|contributed to this report)\b"
EMPTY_TITLE = r"^(home|homepage|latest news|breaking news|global news|news|welcome)(\s*[|\-].*)?$"

_ANY_FURNITURE, _ANY_TAIL = ([re.compile(p, re.I) for p in some] for some in (FURNITURE, TAIL_HEADS))
_CREDIT, _BYLINE, _NOTE, _EMPTY_TITLE = (re.compile(p, re.I) for p in (CREDIT, BYLINE, AUTHOR_NOTE, EMPTY_TITLE))
_LINK, _DIGITS, _WORD = re.compile(r"https?://\S+"), re.compile(r"\d+"), re.compile(r"\w+")


def compared_form(paragraph: str) -> str:
    """`paragraph_key` of one text, in Python."""
    return " ".join(_WORD.findall(_DIGITS.sub("#", _LINK.sub("", paragraph.lower()))))


def _is_noise(paragraph: str, at: int, n: int) -> bool:
    """Furniture anywhere; at the edges (first two, last three) author notes and credits; a byline at the head."""
    if any(p.search(paragraph) for p in _ANY_FURNITURE) or (at == 0 and _BYLINE.fullmatch(paragraph)):
        return True
    return (at < 2 or at >= n - 3) and bool(_NOTE.search(paragraph) or _CREDIT.fullmatch(paragraph))


def _without_fragments(paragraphs: Sequence[str]) -> list[str]:
    """Each text once; of neighbours, one of which holds the other (60 characters and 35 % of it at least), the longer."""
    part_of = lambda a, b: len(a) >= 60 and a in b and len(a) >= 0.35 * len(b)
    kept: dict[str, str] = {}  # form to paragraph, in order
    last = None
    for p in paragraphs:
        form = compared_form(p)
        if form in kept or (last is not None and not part_of(last, form) and part_of(form, last)):
            continue
        if last is not None and part_of(last, form):
            del kept[last]
        kept[form], last = p, form
    return list(kept.values())


def clean_article(raw: str | None, title: str | None = None, known: Sequence[bool] = (), delimiter: str = "\n\n") -> tuple[str, int, float, str, list[str]]:
    """(text, words, score, status, reasons) of one article.

    Paragraphs are single-spaced and blank ones skipped. From a promotional heading on (behind the first two
    and the first two fifths) all goes; then noise, paragraphs that `known` marks as boilerplate (by their
    place in raw) and repeated fragments. The score starts at 1 and loses for few words, a single
    paragraph, no telling title and much removed. rejected: under 40 words or a score under 0.35; questionable:
    under 100 or 0.7; else usable.
    """
    flags = dict(enumerate(known))
    every = [(" ".join(p.split()), bool(flags.get(i))) for i, p in enumerate((raw or "").split(delimiter)) if p.strip()]
    behind = max(2, int(len(every) * 0.4))
    end = next((i for i in range(behind, len(every)) if any(p.search(every[i][0]) for p in _ANY_TAIL)), len(every))
    body = [p for i, (p, boiler) in enumerate(every[:end]) if not boiler and not _is_noise(p, i, end)]
    kept = _without_fragments(body)
    text = delimiter.join(kept).strip()
    n, gone = len(_WORD.findall(text)), len(every) - len(kept)
    short = clean_title_text(title)
    losses = [
        ("promotional_tail_removed", end < len(every), 0.0),
        ("duplicate_fragments_removed", len(kept) < len(body), 0.0),
        ("too_short", n < 40, 0.75),
        ("short_article", 40 <= n < 100, 0.25),
        ("single_paragraph", len(kept) <= 1, 0.15),
        ("missing_or_generic_title", not short or bool(_EMPTY_TITLE.match(short)), 0.25),
        ("mostly_boilerplate", gone > 0.4 * len(every), 0.3),
    ]
    score = max(0.0, 1.0 - sum(loss for _, holds, loss in losses if holds))
    status = "rejected" if n < 40 or score < 0.35 - 1e-9 else "questionable" if n < 100 or score < 0.7 - 1e-9 else "usable"
    return text, n, score, status, [name for name, holds, _ in losses if holds]


def clean_title_text(title: str | None) -> str:
    """A title single-spaced, up to its first spaced bar."""
    return " ".join((title or "").split()).split(" | ", 1)[0].strip()


def clean_articles(df: DataFrame, text: str, delimiter: str = "\n", boilerplate: str | None = None, title: str | None = None) -> DataFrame:
    """Adds cleaned, clean_words, quality_score, quality_status and quality_reasons: `clean_article` of every row.

    boilerplate: a column of paragraph keys; which paragraphs have one of them is found by expressions, and only
    those marks go to the one Arrow batch function that reads the text.
    """
    kind = "struct<cleaned: string, clean_words: bigint, quality_score: double, quality_status: string, quality_reasons: array<string>>"

    @F.pandas_udf(kind)
    def cleaned(texts: pd.Series, titles: pd.Series, marks: pd.Series) -> pd.DataFrame:
        rows = [clean_article(t, h, () if m is None else m, delimiter) for t, h, m in zip(texts, titles, marks, strict=True)]
        return pd.DataFrame(rows, columns=["cleaned", "clean_words", "quality_score", "quality_status", "quality_reasons"])

    marks = F.lit(None).cast("array<boolean>")
    if boilerplate is not None:
        known = F.col(boilerplate)
        marks = F.when(F.size(known) > 0, F.transform(F.split(text, re.escape(delimiter)), lambda p: F.array_contains(known, paragraph_key(p))))
    heading = F.col(title) if title else F.lit(None).cast("string")
    out = df.withColumn("__clean", cleaned(F.col(text), heading, marks))
    return out.select(*df.columns, "__clean.*")


def learned_boilerplate(df: DataFrame, key: str, domain: str, text: str, delimiter: str = "\n", low: int = 40, high: int = 500) -> DataFrame:
    """(domain, boilerplate): the keys of the paragraphs that many documents of a domain have at an edge.

    Only paragraphs of `low` to `high` characters are looked at, as if there were no others.
    """
    some = F.filter(F.split(text, re.escape(delimiter)), lambda p: F.length(p).between(low, high))
    found = frequent_edges(df, key, domain, F.transform(some, paragraph_key), low=1, high=2 * high)
    return found.groupBy(domain).agg(F.collect_set("paragraph").alias("boilerplate"))


def reject_repeated_pages(df: DataFrame, domain: str, digest: str, status: str = "quality_status", least: int = 3) -> DataFrame:
    """Rows with status rejected if a domain has their digest `least` times or more; a null digest never counts."""
    many = df.where(F.col(digest).isNotNull()).groupBy(domain, digest).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    out = df.join(many, [domain, digest], "left")
    return out.withColumn(status, F.when(F.col("__n").isNotNull(), "rejected").otherwise(F.col(status))).drop("__n")


SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Chunk(NamedTuple):
    """A run of an article's units; tokens are those of the heading and the text together."""

    index: int
    text: str
    tokens: int
    first_paragraph: int
    last_paragraph: int


def _units(paragraph: str, limit: int, tokens: Callable[[str], list], join: Callable[[list], str]) -> Iterator[tuple[str, int]]:
    """(text, tokens): the paragraph, or sentences of it filled up to `limit`, or runs of tokens of longer ones."""
    size = len(tokens(paragraph))
    if size <= limit:
        yield paragraph, size
        return
    pending: list[str] = []
    held = 0
    for sentence in filter(None, map(str.strip, SENTENCE.split(paragraph))):
        toks = tokens(sentence)
        if pending and held + len(toks) > limit:
            yield " ".join(pending), held
            pending, held = [], 0
        if len(toks) > limit:
            runs = (toks[i : i + limit] for i in range(0, len(toks), limit))
            yield from ((piece, len(r)) for r in runs if (piece := " ".join(join(r).split())))
        else:
            pending, held = [*pending, sentence], held + len(toks)
    if pending:
        yield " ".join(pending), held


def chunk_text(text: str, title: str | None = None, target: int = 500, most: int = 600, overlap: int = 75, least: int = 100, delimiter: str = "\n\n", tokens: Callable[[str], list] = str.split, join: Callable[[list], str] = " ".join) -> list[Chunk]:
    """Chunks of an article on paragraph and sentence borders, each counted with its heading (`heading(title)`).

    Units are paragraphs, or pieces of those over about half of `target`. A chunk takes units until it has
    `target` tokens, and none by which it would pass `most`; the next one repeats the last units, up to
    `overlap` tokens. A last chunk under `least` joins the one before, repeated units once, while that stays
    within `most`. A title that leaves too little room is an error.
    """
    if not 0 <= overlap < target <= most:
        raise ValueError("0 <= overlap < target <= most must hold")
    head = heading(title)
    room, hard = target - len(tokens(head)), most - len(tokens(head))
    if room < max(10, target // 5):
        raise ValueError("the title leaves too little room for text")
    limit = min(max(1, hard - 8), max(64, room // 2))  # some tokens to spare: joined units may have more than their sum
    paragraphs = [" ".join(p.split()) for p in (text or "").split(delimiter) if p.strip()]
    units = [(u, n, i) for i, p in enumerate(paragraphs) for u, n in _units(p, limit, tokens, join)]
    whole = lambda a, b: "\n\n".join(u for u, *_ in units[a:b])
    size = lambda body: len(tokens(head + body))
    spans: list[tuple[int, int]] = []
    begin = 0
    while begin < len(units):
        end = begin + 1
        while size(whole(begin, end)) < target and end < len(units) and size(whole(begin, end + 1)) <= most:
            end += 1
        spans.append((begin, end))
        if end == len(units):
            break
        back, shared = end, 0
        while back > begin + 1 and shared + units[back - 1][1] <= overlap:
            back -= 1
            shared += units[back][1]
        begin = back
    # consecutive spans overlap in the units that they share, so their union has those once
    while len(spans) > 1 and size(whole(*spans[-1])) < least and size(whole(spans[-2][0], spans[-1][1])) <= most:
        spans[-2:] = [(spans[-2][0], spans[-1][1])]
    return [Chunk(k, whole(a, b), size(whole(a, b)), units[a][2], units[b - 1][2]) for k, (a, b) in enumerate(spans)]


def heading(title: str | None) -> str:
    """What stands before a chunk when it is embedded."""
    return f"Title: {' '.join((title or 'Untitled article').split())}\n\n"


def chunk_documents(df: DataFrame, key: str, text: str, title: str | None = None, **limits) -> DataFrame:
    """(key, chunk_index, chunk, tokens, first_paragraph, last_paragraph) of every document; whole texts, one pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, t, h in zip(pdf["__k"], pdf["__t"], pdf["__h"], strict=True) for c in chunk_text(t or "", h, **limits)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk", "tokens", "first_paragraph", "last_paragraph"])

    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("__k"), F.col(text).alias("__t"), (F.col(title) if title else F.lit(None).cast("string")).alias("__h"))
    return slim.mapInPandas(run, f"{key} {kind}, chunk_index int, chunk string, tokens int, first_paragraph int, last_paragraph int")


def budgeted_concat(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, budget: int, name: str = "text", notice: str = " [truncated]") -> DataFrame:
    """Texts of a group in order, cut where they pass `budget` characters, with a notice if they do."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = df.withColumn("__before", before).withColumn("__part", F.left(text, F.greatest(F.lit(budget) - F.col("__before"), F.lit(0)).cast("int")))
    out = part.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__part") != "", F.struct("__before", *[o for o in order], F.col("__part").alias("p"))))), lambda s: s["p"]), "").alias("__t"), F.sum(F.length(text)).alias("__all")
    )
    return out.select(*keys, F.when(F.col("__all") > budget, F.concat("__t", F.lit(notice))).otherwise(F.col("__t")).alias(name))
