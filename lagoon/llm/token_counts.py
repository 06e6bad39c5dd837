"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one ragged numpy array of symbol ids. Each round finds, for every
sequence at once, its adjacent pair of lowest merge rank, and applies that pair at all its places.
The count of a pre-token is the number of symbols that survive.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagoon.llm.common import row_slices, text_or_empty

#: The split that byte-level BPE files with `use_regex` assume.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_MERGE = np.iinfo(np.int32).max
SPACE = " \\n\\t\\r\\x0b\\x0c"
SPACE_AFTER_SPACE = ["  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c "]
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: White space, to one library or another, besides the six ASCII ones: a text that has any is not cut.
RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in plain:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], spare = chr(spare), spare + 1
    return out


def merge_counts(symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, width: int) -> np.ndarray:
    """Surviving symbols of each sequence.

    symbols: the sequences' ids end to end; lengths: of each sequence, none empty; keys: sorted
    left * width + right of the mergeable pairs, with their ranks and the ids they make.
    """
    counts = lengths.astype(np.int64)
    alive = np.arange(len(lengths))
    sym, size = symbols.astype(np.int64), lengths.astype(np.int64)
    last = np.zeros(len(sym), bool)
    last[np.cumsum(size) - 1] = True
    rank = np.empty(len(sym), np.int32)
    entry = np.zeros(len(sym), np.int64)

    def look_up(where: np.ndarray) -> None:
        """Rank and entry of the pairs that begin at these places."""
        pair = np.where(last[where], -1, sym[where] * width + sym[np.minimum(where + 1, len(sym) - 1)])
        at = np.searchsorted(keys, pair)
        at[at == len(keys)] = 0
        rank[where] = np.where(keys[at] == pair, ranks[at], NO_MERGE)
        entry[where] = at

    look_up(np.arange(len(sym)))
    while len(alive):
        starts = np.cumsum(size) - size
        best = np.minimum.reduceat(rank, starts)
        moving = best < NO_MERGE
        counts[alive[~moving]] = size[~moving]
        # a symbol takes part in one merge: of places in a row every second one, from the left
        idx = np.flatnonzero((rank == np.repeat(best, size)) & (rank < NO_MERGE))
        if len(idx):
            run_start = np.ones(len(idx), bool)
            run_start[1:] = idx[1:] != idx[:-1] + 1
            first = np.flatnonzero(run_start)
            place = np.arange(len(idx)) - np.repeat(first, np.diff(np.append(first, len(idx))))
            idx = idx[place % 2 == 0]
        sym[idx] = made[entry[idx]]
        last[idx] = last[idx + 1] if len(idx) else False
        keep = np.repeat(moving, size)
        lost = np.add.reduceat(np.bincount(idx + 1, minlength=len(sym) + 1)[: len(sym)], starts)
        keep[idx + 1] = False
        moved = (np.cumsum(keep) - 1)[idx]
        sym, last, rank, entry = sym[keep], last[keep], rank[keep], entry[keep]
        size, alive = (size - lost)[moving], alive[moving]
        if len(sym):
            before = moved[moved > 0] - 1
            look_up(np.concatenate([moved, before]))
    return counts


class BpeCounter:
    """Counts tokens as the library does for a byte-level BPE file, without special tokens added.

    Special tokens that occur in a text count one each, as the library finds them by default.
    """

    def __init__(self, path: str, cache: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without a normaliser are understood")
        vocab = model["vocab"]
        self.width = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.of_byte = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.split = regex.compile(BYTE_LEVEL_SPLIT)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.special_words = special
        self.known: dict[str, int] = {}
        self.known_chunks: dict[str, int] = {}
        self.most = cache

    def merged(self, words: list[str]) -> list[int]:
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
        return merge_counts(symbols, lengths, self.keys, self.ranks, self.made, self.width).tolist()

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk; pre-tokens are merged once while the cache has room."""
        words = [self.split.findall(c) for c in chunks]
        new = [w for w in set().union(*words) if w not in self.known]
        counts = dict(zip(new, self.merged(new), strict=True)) if new else {}
        if len(self.known) + len(counts) <= self.most:
            self.known.update(counts)
            counts = self.known
            return [sum(map(counts.__getitem__, w)) for w in words]
        known = self.known
        return [sum(counts[x] if x in counts else known[x] for x in w) for w in words]

    def segments(self, text: str) -> tuple[list[str], int]:
        """The text between special tokens, and how many of those there are."""
        if self.special is None or not any(s in text for s in self.special_words):
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    @staticmethod
    def chunks(text: str, block: int) -> Iterator[list[str]]:
        """The text cut where no pre-token crosses: before ASCII white space that follows none.

        Of white space in a row all but the last is one pre-token, so such a run stays whole.
        """
        if len(text) <= block and not any(s in text for s in SPACE_AFTER_SPACE) and (text.isascii() or not RARE_SPACE.search(text)):
            head, *rest = text.split(" ")
            yield [head, *[f" {w}" for w in rest]] if head else [f" {w}" for w in rest]
        elif RARE_SPACE.search(text):
            yield [text] if text else []
        else:
            found = (m.group() for m in CHUNK.finditer(text))
            while some := list(islice(found, block)):
                yield some

    def count(self, texts: list[str], block: int = 1_000_000) -> list[int]:
        out = [0] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        waiting = 0

        def settle() -> None:
            nonlocal waiting
            known = self.known_chunks
            new = [c for c in set().union(*(c for _, c in pending)) if c not in known]
            counts = dict(zip(new, self.count_chunks(new), strict=True))
            if len(known) + len(counts) <= self.most:
                known.update(counts)
                counts = None
            for i, chunks in pending:
                out[i] += sum(map(known.__getitem__, chunks)) if counts is None else sum(known[c] if c in known else counts[c] for c in chunks)
            pending.clear()
            waiting = 0

        for i, text in enumerate(texts):
            parts, n = self.segments(text)
            out[i] += n
            for part in parts:
                for some in self.chunks(part, block):
                    pending.append((i, some))
                    waiting += len(some)
                    if waiting > block:
                        settle()
        settle()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, n_bytes, n_tokens, over_limit.

    A null text counts as an empty one: 0 bytes, 0 tokens. Repeated rows are counted each, a null id
    stays null, an empty table gives an empty result; other columns of `docs` are not read.
    No shuffle: one pass over two columns. Whole texts are counted, whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(tokenizer_path)
        for b in row_slices(batches, rows=256, text=1):
            texts = b.column(1).to_pylist()
            n = bpe.count(texts)
            yield pa.record_batch([b.column(0), pa.compute.cast(pa.compute.binary_length(b.column(1)), pa.int64()), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
