"""Benchmark decontamination by the q-gram lemma.

A region within k edits of a passage of m characters shares at least m - q + 1 - k q of its q-grams,
all on diagonals that differ by at most k. Shared q-grams are counted in overlapping bands of 2 (k + 1)
diagonals; regions that reach the bound are verified by a banded alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lagoon.llm.common import materialise, row_slices, text_or_empty

MIX = np.uint64(0x9E3779B97F4A7C15)
END = 0x110000  # no character: stands between texts


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, white space in a row as one space; and each one's place in `text`."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[:1] or c for c in text)
    code = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.int64)
    space = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0) | (code == 0x85) | ((code >= 0x2000) & (code <= 0x200A)) | (code == 0x2028) | (code == 0x2029) | (code == 0x3000)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    code = np.where(space, 32, code)[keep]
    return code, np.flatnonzero(keep)


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q code points that begin at each place; the last q - 1 places have none."""
    n = len(code) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # doubling: a hash of 2 w characters from two of w
    value, width = code.astype(np.uint64) * MIX, 1
    value ^= value >> np.uint64(29)
    parts, at, left = None, 0, q
    while left:
        if left & width:
            piece = value[at : at + n]
            parts = piece.copy() if parts is None else (parts * MIX) ^ (piece + (parts >> np.uint64(31)))
            at += width
            left -= width
        if left:
            value = (value[:-width] * MIX) ^ (value[width:] + (value[:-width] >> np.uint64(31)))
            width *= 2
    return parts


def align(item: np.ndarray, window: np.ndarray, shift: int, half: int, most: int) -> tuple[int, int, int]:
    """Fewest edits between `item` and a part of `window`, on diagonals shift - half .. shift + half.

    Returns edits, begin and end of that part; stops early, with more than `most` edits, when no cell is
    left within them. Free ends in the window; unit costs.
    """
    m, n, width = len(item), len(window), 2 * half + 1
    far = np.int64(1 << 30)
    offs = np.arange(width)
    # cell d of row i is window place i + shift - half + d
    place = shift - half + offs
    cost = np.where((place >= 0) & (place <= n), 0, far)
    begin = place.copy()
    # window places from the first row's to the last row's, padded so that every row is a slice
    padded = np.full(m + width + 1, -1, np.int64)
    first = shift - half
    a, b = max(0, first), min(n, first + m + width)
    if b > a:
        padded[a - first : b - first] = window[a:b]
    up, up_begin = np.empty(width, np.int64), np.zeros(width, np.int64)
    up[-1] = far
    for i in range(1, m + 1):
        left = i + first
        diag = cost + (padded[i - 1 : i - 1 + width] != item[i - 1])
        up[:-1] = cost[1:]
        up_begin[:-1] = begin[1:]
        new = np.minimum(diag, up + 1)
        new_begin = np.where(diag <= up + 1, begin, up_begin)
        reach = np.minimum.accumulate(new - offs)
        src = np.maximum.accumulate(np.where(new - offs == reach, offs, 0))
        cost, begin = reach + offs, new_begin[src]
        if left < 0:
            cost[: min(width, -left)] = far
        if left + width - 1 > n:
            cost[max(0, n - left + 1) :] = far
        if cost.min() > most:
            return most + 1, 0, 0
    best = int(np.argmin(cost))
    return int(cost[best]), int(begin[best]), m + first + best


@dataclass
class Passages:
    """The index of one block of passages: sorted q-gram hashes with their postings."""

    ids: list
    codes: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    q: int

    @staticmethod
    def tiers(ids: list, texts: list[str], q: int, rate: float, table_bits: int = 22) -> list[Passages]:
        """Indexes that hold each passage once, with grams short enough for its edit budget.

        The bound m - q + 1 - k q is above 0 for q <= m / (k + 1) only: most passages take `q`, shorter
        ones less, and one without edits at most its own length. Passages without characters have no place.
        """
        codes = [normalise(t)[0] for t in texts]
        codes = [c[np.argmax(c != 32) :] if (c != 32).any() else c[:0] for c in codes]
        codes = [c[: len(c) - np.argmax(c[::-1] != 32)] if len(c) else c for c in codes]
        budget = [int(rate * len(c) + 1e-9) for c in codes]
        grams: dict[int, list[int]] = {}
        for i, (c, k) in enumerate(zip(codes, budget, strict=True)):
            if len(c):
                grams.setdefault(max(1, min(q, len(c) // (k + 1))), []).append(i)
        return [Passages.build([ids[i] for i in some], [codes[i] for i in some], [budget[i] for i in some], size, table_bits if size == q else 16) for size, some in sorted(grams.items(), reverse=True)]

    @staticmethod
    def build(ids: list, codes: list[np.ndarray], budget: list[int], q: int, table_bits: int) -> Passages:
        size, edits = np.array([len(c) for c in codes], np.int64), np.array(budget, np.int64)
        need = size - q + 1 - edits * q
        grams = [gram_hashes(c, q) for c in codes]
        all_h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(all_h, kind="stable")
        hashes, first = np.unique(all_h[order], return_index=True)
        seen = np.zeros(1 << table_bits, bool)
        seen[hashes >> np.uint64(64 - table_bits)] = True
        # half the width where it will do: each Python worker holds an index
        slim = lambda x: x.astype(np.int32) if len(all_h) < 2**31 else x
        return Passages(ids, codes, edits, need, hashes, slim(np.append(first, len(order))), slim(item[order]), slim(place[order]), seen, q)

    def regions(self, code: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of the bands that reach their bound."""
        h = gram_hashes(code, self.q)
        bits = int(len(self.seen) - 1).bit_length()
        at = np.flatnonzero(self.seen[h >> np.uint64(64 - bits)])
        if not len(at) or not len(self.hashes):
            return []
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        at, k = at[hit], k[hit]
        if not len(at):
            return []
        many = (self.first[k + 1] - self.first[k]).astype(np.int64)
        ends = np.cumsum(many)
        cells: list[tuple[np.ndarray, np.ndarray]] = []
        stride, shift = self.edits + 1, max((len(c) for c in self.codes), default=0)
        span = (len(code) + shift) + 2
        done = 0
        while done < len(at):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, side="right")))
            some = many[done:upto]
            post = np.repeat(self.first[k[done:upto]].astype(np.int64) - (np.cumsum(some) - some), some) + np.arange(some.sum())
            item = self.item[post].astype(np.int64)
            diagonal = np.repeat(at[done:upto], some) - self.place[post] + shift
            cells.append(np.unique(item * span + diagonal // stride[item], return_counts=True))
            done = upto
        key = np.concatenate([c[0] for c in cells])
        n = np.concatenate([c[1] for c in cells])
        if len(cells) > 1:
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, weights=n).astype(np.int64)
        follows = np.zeros(len(key), bool)
        follows[:-1] = key[1:] == key[:-1] + 1
        total = n + np.where(follows, np.append(n[1:], 0), 0)
        # a band is a cell and the next one; it may begin with an empty cell, then the next one has its count
        item, cell = key // span, key % span
        good = np.flatnonzero(total >= self.need[item])
        return [(int(item[g]), int(cell[g] * stride[item[g]] - shift), int((cell[g] + 2) * stride[item[g]] - 1 - shift)) for g in good]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, passage, begin, end, edits) of the verified regions; begin and end in the raw text."""
        parts, places, starts, at = [], [], [], 0
        for t in texts:
            code, place = normalise(t)
            parts += [code, np.array([END])]
            places.append(np.append(place, len(t)))
            starts.append(at)
            at += len(code) + 1
        if not parts:
            return
        code, start = np.concatenate(parts), np.array(starts)
        bands: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, low, high in self.regions(code):
            size, k = len(self.codes[item]), int(self.edits[item])
            a, b = max(0, low - k), min(len(code), high + size + k)
            for row in range(max(0, int(np.searchsorted(start, a, side="right")) - 1), int(np.searchsorted(start, b))):
                begin, stop = int(start[row]), int(start[row]) + len(places[row]) - 1
                if min(b, stop) - max(a, begin) >= size - k:
                    bands.setdefault((row, item), []).append((low - begin, high - begin))
        for (row, item), some in bands.items():
            begin = int(start[row])
            text = code[begin : begin + len(places[row]) - 1]
            where = places[row]
            for cost, s, e in self.verified(item, text, some):
                yield row, item, int(where[s]), int(where[e - 1]) + 1 if e > s else int(where[s]), cost

    def verified(self, item: int, text: np.ndarray, bands: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(edits, begin, end) of regions of one text that do not overlap, those of fewest edits first.

        Equal regions are looked for first. A band all of whose regions would overlap an equal one is
        needless, since that one would be preferred.
        """
        passage, k = self.codes[item], int(self.edits[item])
        size, wanted = len(passage), passage.astype("<u4").tobytes()
        equal: set[int] = set()
        for low, high in bands:
            a, b = max(0, low - k), min(len(text), high + size + k)
            raw, at = text[a:b].astype("<u4").tobytes(), -1
            while (at := raw.find(wanted, at + 1)) >= 0:
                if at % 4 == 0:
                    equal.add(a + at // 4)
        if not k:  # no edit allowed; so short a passage counts as whole words only
            edge = lambda at: not 0 <= at < len(text) or not (chr(int(text[at])).isalnum())
            equal = {s for s in equal if edge(s - 1) and edge(s + size)}
        found = {(0, s, s + size) for s in equal}
        if not k:
            bands = []
        for low, high in bands:
            if any(low - k + size - k > s and high + k < s + size for s in equal):
                continue
            a, b = max(0, low - k), min(len(text), high + size + k)
            cost, s, e = align(passage, text[a:b], (low + high) // 2 - a, (high - low) // 2 + 1 + k, k)
            if cost <= k:
                found.add((cost, a + s, a + e))
        taken: list[tuple[int, int, int]] = []
        for cost, s, e in sorted(found):
            if all(e <= x or s >= y for _, x, y in taken):
                taken.append((cost, s, e))
        return taken


def passage_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[tuple[list, list[str]]]:
    """The benchmark in blocks of about `block_chars`, one in the driver's memory at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col), text_or_empty(text_col)).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


class Index:
    """Passages in blocks: the tiers of all blocks of one pass over the documents."""

    def __init__(self, blocks: list[list[Passages]]):
        self.parts = [tier for block in blocks for tier in block]

    def matches(self, texts: list[str]) -> Iterator[tuple[int, object, int, int, int, int]]:
        """(row, passage id, begin, end, edits, passage characters) of every region found in the texts."""
        for p in self.parts:
            for row, i, begin, end, cost in p.matches(texts):
                yield row, p.ids[i], begin, end, cost, len(p.codes[i])


def passes(benchmark: DataFrame, q: int, rate: float, block_chars: int, pass_blocks: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[Broadcast, bool]]:
    """A broadcast index for each pass over the documents, and whether more follow.

    A pass holds `pass_blocks` blocks at most, so a worker's memory does not grow with the benchmark: some
    30 bytes a character of them. The index of one pass is destroyed when the next one is asked for.
    """
    sc = benchmark.sparkSession.sparkContext
    blocks = passage_blocks(benchmark, id_col, text_col, block_chars)
    some = list(islice(blocks, pass_blocks))
    while some:
        held = sc.broadcast(Index([Passages.tiers(i, t, q, rate) for i, t in some]))
        some = list(islice(blocks, pass_blocks))
        yield held, bool(some)
        if some:
            held.destroy()


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_chars: int = 1_000_000, pass_blocks: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per region of a document that repeats a benchmark passage.

    Columns: the document's id, the passage's id, begin and end (code points of the raw text), edits,
    item_chars. Compared in lower case with white space folded. A passage of m characters may differ by
    floor(rate m) edits; one too short for any edit (under 1 / rate characters) must stand unchanged, as
    whole words. A passage without characters matches nothing. Of overlapping regions for one passage the
    one of fewest edits is kept, then the first. Null texts are empty; repeated rows and repeated passages
    give rows each; empty tables give an empty result; other columns are not read.

    The benchmark goes to the executors in blocks of `block_chars`; a pass over the documents takes
    `pass_blocks` of them, so that one pass does for most benchmarks. Nothing is shuffled.
    """
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("item", item_type), *(T.StructField(c, T.LongType()) for c in ("begin", "end", "edits", "item_chars"))])
    arrow = to_arrow_schema(schema)
    out = None
    for held, more in passes(benchmark, q, rate, block_chars, pass_blocks, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in row_slices(batches, rows=256, text=1, size=1_000_000):
                ids = b.column(0).to_pylist()
                found = [(ids[row], *rest) for row, *rest in held.value.matches(b.column(1).to_pylist())]
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        part = slim.mapInArrow(run, schema)
        part = materialise(part) if more or out is not None else part
        out = part if out is None else out.unionByName(part)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    item_name = item_col if item_col.lower() != id_col.lower() else "benchmark_" + item_col
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_name), "begin", "end", "edits", "item_chars")


def unmatched(held: Broadcast) -> Callable[[Column], Column]:
    """A column function: whether a text repeats none of the index's passages."""

    @F.pandas_udf(T.BooleanType())
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        batch = pa.record_batch([pa.array(texts, pa.string()).fill_null("")], names=["text"])
        at = 0
        for b in row_slices([batch], rows=256, text=0, size=1_000_000):
            for row, *_ in held.value.matches(b.column(0).to_pylist()):
                out[at + row] = False
            at += b.num_rows
        return pd.Series(out)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = 8, rate: float = 0.1, block_chars: int = 1_000_000, pass_blocks: int = 8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that repeat no benchmark passage, with all their columns; see benchmark_overlaps."""
    for held, more in passes(benchmark, q, rate, block_chars, pass_blocks, item_col, item_text_col):
        docs = docs.where(unmatched(held)(text_or_empty(text_col)))
        docs = materialise(docs, compression="zstd") if more else docs
    return docs
