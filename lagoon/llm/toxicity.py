"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding takes letters that look alike, digits and signs that stand for letters, marks and case to plain
Latin letters, so that disguised words meet their lexicon entry. Entries are whole words or beginnings
of words, with log-odds weights learned from labelled rows; exception phrases cancel the hits inside
them. The sum of weights, normalised by length, goes through a logistic function.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log1p, sqrt

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.common import materialise, row_slices, text_or_empty

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ø": "o", "ł": "l", "đ": "d", "ħ": "h", "æ": "ae", "œ": "oe", "ß": "ss",
}
#: Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "£": "l"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "clown fish", "rodeo clown", "pond scum", "sore loser"]
ZERO_WIDTH = "­​‌‍⁠﻿"


#: Scripts written without spaces: each letter stands for a word.
UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR")
#: Single Latin letters in a row, as in a word with something between its letters.
SPELLED = re.compile(r"(?<= )(?:[a-z] ){2,}[a-z](?= )")


class FoldTable(dict):
    """Code point to its folded form, made when it is first met: letters folded, all else a word break."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if c in ZERO_WIDTH or unicodedata.combining(c):
            out = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(HOMOGLYPHS.get(x, SUBSTITUTES.get(x, x)) for x in plain)
            if not out or not all(x.isalpha() for x in out):
                out = " "
            elif unicodedata.name(c, "").startswith(UNSPACED):
                out = f" {out} "
        self[point] = out
        return out


@lru_cache(maxsize=1)
def fold_table() -> FoldTable:
    return FoldTable()


@lru_cache(maxsize=1)
def ascii_table() -> bytes:
    return bytes(ord(fold_table()[i]) if i < 128 else 32 for i in range(256))


def fold(text: str) -> list[str]:
    """Folded words of the whole text; three or more single Latin letters in a row are joined to a word."""
    if text.isascii():
        words = text.encode().translate(ascii_table()).decode("ascii").split()
    else:
        words = text.translate(fold_table()).split()
    line = f" {' '.join(words)} "
    if SPELLED.search(line):
        return SPELLED.sub(lambda m: m[0].replace(" ", ""), line).split()
    return words


def entries(word: str, shortest: int = 4, longest: int = 6) -> list[str]:
    """Lexicon entries a word could match: the word itself, ` word `, and its beginnings, ` wor`."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(shortest, min(longest, len(word)) + 1))]


@dataclass
class Lexicon:
    """Weighted entries, exceptions, and the logistic function of the length-normalised sum."""

    weights: dict[str, float]
    exceptions: list[str]
    bias: float = -4.0
    slope: float = 4.0
    trained: bool = True
    automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def search(self) -> ahocorasick.Automaton:
        if self.automaton is None:
            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            for entry, w in self.weights.items():
                if entry not in a:
                    a.add_word(entry, (len(entry), w))
            if len(a):
                a.make_automaton()
            self.automaton = a
        return self.automaton

    def strength(self, text: str) -> float:
        """Sum of the weights of the words hit, over the root of the length; a word counts its best entry once."""
        words = fold(text)
        if not words or not self.weights:
            return 0.0
        line = f" {' '.join(words)} "
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, w) in self.search().iter(line):
            begin = end - size + 1
            if w is None:
                spared.append((begin, end))
            else:
                hits[begin] = max(w, hits.get(begin, w))
        begins = sorted(hits) if spared else []
        for x, y in spared:
            for i in range(bisect_left(begins, x), bisect_left(begins, y)):
                hits.pop(begins[i], None)
        return sum(hits.values()) / sqrt(len(words) + 1.0)

    def feature(self, text: str) -> float:
        return log1p(max(0.0, self.strength(text)) * 10.0)

    def score(self, text: str) -> float:
        if not self.trained:
            return 0.0
        z = self.bias + self.slope * self.feature(text)
        return 1.0 / (1.0 + exp(-z)) if z > -700 else 0.0


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Bias and slope by Newton's method, the slope kept finite by a ridge."""
    share = np.ones(len(y))
    design = np.column_stack([np.ones_like(x), x])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (share * (y - p)) - ridge * len(y) * np.array([0, 1e-2]) * beta
        hess = (design * (share * p * (1 - p))[:, None]).T @ design + ridge * len(y) * np.diag([1e-6, 1e-2]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of at most `most` labelled ids outside the held-out third, those of least hash.

    A row an id: of rows that repeat an id the least text, of labels that do the highest.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(most)
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, least_docs: int = 5, least_weight: float = 2.0, least_ratio: float = 20.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon of a bounded sample of `most_rows` labelled documents.

    An entry is kept if at least `least_docs` toxic documents have it, its log-odds reach `least_weight`
    and its likelihood ratio against no association reaches `least_ratio`; a beginning of words makes longer entries under it needless unless they weigh more.
    Words under a kept beginning that are commoner in clean documents become exceptions. All entries that
    pass are kept: the sample's vocabulary bounds them. Without labels of both classes nothing is learned:
    every score is 0.
    """
    sample = materialise(labelled_sample(docs, labels, most_rows, id_col, text_col, label_col))
    sizes = {int(r["toxic"] > 0): r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({}, [], trained=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, rows=512, text=0):
            toxic, clean = Counter(), Counter()
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if label > 0 else clean).update({e for w in set(fold(text)) for e in entries(w)})
            # an entry that clean documents alone have can only be an exception to a toxic beginning
            keys = list(toxic.keys() | clean.keys())
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["entry", "t", "c"])

    n_toxic, n_clean = sizes[1], sizes[0]
    counts = materialise(sample.mapInArrow(count, "entry string, t bigint, c bigint").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    share, both = n_toxic / (n_toxic + n_clean), F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (both * (1 - share)))).otherwise(0))
    good = counts.where(F.col("t") >= least_docs).where(ratio >= least_ratio).withColumn("w", weight).where(F.col("w") >= least_weight)
    kept: dict[str, float] = {}
    for r in sorted(good.select("entry", "w").collect(), key=lambda r: (len(r["entry"]), r["entry"])):
        entry = r["entry"]
        above = [kept[entry[:n]] for n in range(2, len(entry)) if entry[:n] in kept]
        if not above or r["w"] > max(above) + 0.5:
            kept[entry] = r["w"]
    beginnings = [e for e in kept if not e.endswith(" ")]
    spared = list(EXCEPTIONS)
    if beginnings:
        under = F.col("entry").endswith(" ") & F.substring("entry", 1, 5).isin(sorted({e[:5] for e in beginnings}))
        harmless = counts.where(under & (F.col("c") >= 3) & (weight < 0)).select("entry").collect()
        spared += sorted(r["entry"] for r in harmless if r["entry"] not in kept)
    lexicon = Lexicon(kept, [f" {' '.join(fold(p))} " for p in spared])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([lexicon.feature(t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "toxic"])

    pairs = sample.mapInArrow(measure, "x double, toxic int").toArrow()
    x, y = pairs.column(0).to_numpy(), (pairs.column(1).to_numpy() > 0).astype(float)
    order = np.lexsort((y, x))
    lexicon.bias, lexicon.slope = logistic(x[order], y[order])
    if lexicon.slope <= 0:
        return Lexicon({}, [], trained=False)
    return lexicon


def scorer(lexicon: Lexicon, docs: DataFrame):
    """A column function: the score of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        lex = shared.value
        return pd.Series([lex.score(t or "") for t in texts], dtype="float64")

    return lambda text_col: score(text_or_empty(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """One row per row of `docs`: the id, held_out, score, predicted.

    Only texts enter a score. Null texts are empty and score like any text without a hit. Repeated rows
    and null ids stay (a null id is never held out, nor labelled); an empty table gives an empty result;
    without labels of both classes every score is 0. Other columns are not read. The lexicon is bounded
    by the vocabulary of `most_rows` documents and is broadcast; scoring is one pass without a shuffle.
    """
    lexicon = learn(docs, labels, id_col=id_col, text_col=text_col, **learning)
    out = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), scorer(lexicon, docs)(text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **learning) -> DataFrame:
    """The rows of `docs` that score under the threshold, with all their columns; see toxicity."""
    lexicon = learn(docs, labels, id_col=id_col, text_col=text_col, **learning)
    return docs.where(scorer(lexicon, docs)(text_col) < threshold)
