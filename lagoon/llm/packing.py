"""Best-fit packing by minimum bin slack.

Only lengths matter to a packing, and there are at most `capacity` of them: the table is reduced to a
histogram of piece lengths, and minimum bin slack runs on that. Each step takes the longest piece left
and, by subset-sum over the available lengths in a bitset, the fullest bin that holds it; the same
combination is then removed as often as the counts allow, so steps follow the number of lengths and
not of pieces. Pieces are numbered within their length and look up their bin in the steps' table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.common import materialise, row_slices, text_or_empty


#: Letters and digits as a, full stop and comma as ., white space kept, the rest as x.
KINDS = bytes(97 if chr(i).isalnum() and i < 128 else 46 if i in b".," else i if i in b" \n" else 120 for i in range(256))


class Known(dict):
    """Ids by word; a word without them gives None and is noted, so that a text costs one look-up a word."""

    def __init__(self):
        super().__init__()
        self.new: dict[bytes, None] = {}
        self.missed = 0

    def __missing__(self, word: bytes) -> None:
        self.new[word] = None
        self.missed += 1


class WordCache:
    """Token ids of texts by a tokenizer whose words never cross ASCII white space.

    Holds for files that drop white space before splitting; checked on loading. Words are encoded by
    the library and remembered.
    """

    #: One full stop or comma between an ASCII letter and a space is a word of its own to the tokenizer.
    STOP = re.compile(rb"(?<=[A-Za-z])([.,])(?=[ \n])")

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known = Known()
        self.most = most
        coded = lambda x: self.library.encode(x, add_special_tokens=False).ids
        for probe in ("one two", "a\n\nb", " x\t'll y ", "1 2\r\n3"):
            if coded(probe) != [i for w in probe.split() for i in coded(w)]:
                raise ValueError("this tokenizer's words cross white space")
        self.folds = coded("ABC Xyz") == coded("abc xyz")
        self.stops = coded("abc, x. 1, 2") == coded("abc , x . 1 , 2")
        special = [t.content for t in self.library.get_added_tokens_decoder().values() if t.special and t.content.startswith("<|")]
        self.between = special[0] if special else None
        self.mark = self.library.token_to_id(self.between) if special else -1

    def words(self, text: str) -> list[bytes]:
        """The text cut at white space; case and stops are taken off where they do not change the ids."""
        raw = text.encode()
        if b"<|" in raw:  # perhaps a special token, which is found before case is dropped
            return raw.split()
        if self.folds:
            raw = raw.lower()
        if self.stops:
            kinds = raw.translate(KINDS)
            if b"x. " in kinds or b".. " in kinds:
                raw = self.STOP.sub(rb" \1", raw)
            else:  # every stop before white space follows a letter or a digit
                raw = raw.replace(b", ", b" , ").replace(b". ", b" . ")
        return raw.split()

    def encode(self, words: list[bytes], together: int = 2000) -> dict[bytes, bytes]:
        """Ids of distinct words; many go to the library as one text with a special token between."""
        made = {}
        alone = [w for w in words if self.between is None or b"<|" in w]
        for w in alone:
            made[w] = np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        some = [w for w in words if w not in made] if alone else words
        blocks = [some[i : i + together] for i in range(0, len(some), together)]
        texts = [self.between.join(w.decode() for w in b) for b in blocks]
        for block, coded in zip(blocks, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            cut = np.flatnonzero(ids == self.mark)
            raw, at = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()]
            made.update(zip(block, (raw[a:b] for a, b in zip(at, [*(4 * cut).tolist(), len(raw)], strict=True)), strict=True))
        return made

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, end to end."""
        words, found, holes = [self.words(t) for t in texts], [], []
        known = self.known
        for i, w in enumerate(words):
            before = known.missed
            found.append(list(map(known.__getitem__, w)))
            if known.missed > before:
                holes.append(i)
        if holes:
            made = self.encode(list(known.new))
            for i in holes:
                found[i] = [made[x] if ids is None else ids for ids, x in zip(found[i], words[i], strict=True)]
            known.new.clear()
            if len(known) + len(made) <= self.most:
                known.update(made)
        return [b"".join(x) for x in found]


@lru_cache(maxsize=2)
def word_cache(path: str) -> WordCache:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordCache(path)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> list[int]:
    """Lengths, with repeats, whose sum is the largest that fits `room`; longest lengths preferred.

    With a slack the first sums found within it will do, so that short lengths are kept for later.

    Subset-sum in one integer's bits. Lengths come in decreasing order, and `reach[i]` keeps the sums
    possible with those before the i-th, for the way back. Stops when `room` itself is reached.
    """
    goal = ((1 << (room + 1)) - 1) ^ ((1 << max(0, room - slack)) - 1)
    mask, reach, used = (1 << (room + 1)) - 1, [], []
    sums = 1
    if sums & goal:
        return []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length], room // length)
        step = 1
        while left:  # binary splitting of the multiplicity
            take = min(step, left)
            reach.append(sums)
            used.append((length, take))
            sums |= (sums << (length * take)) & mask
            if sums & goal:
                break
            left -= take
            step *= 2
        if sums & goal:
            break
    total, out = sums.bit_length() - 1, []
    for before, (length, take) in zip(reversed(reach), reversed(used), strict=True):
        if not before >> total & 1:
            out += [length] * take
            total -= length * take
    return out


@dataclass
class Plan:
    """Rows: for a length, pieces numbered from `start` up to `stop` go to a run of equal bins.

    Sorted by length and start: bins from `bin`, `times` pieces in each, the first at `offset`.
    """

    length: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    bin: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the pieces with these lengths and numbers within the length."""
        big = int(self.stop.max()) + 1 if len(self.stop) else 1
        scale = np.float64(1) * big
        if len(self.length) and float(self.length.max() + 1) * scale >= 2**63:
            raise OverflowError("too many pieces for 64-bit keys")
        row = np.searchsorted(self.length * big + self.start, length * big + number, side="right") - 1
        place = number - self.start[row]
        return self.bin[row] + place // self.times[row], self.offset[row] + place % self.times[row] * length


#: Shares of the capacity that a bin may leave free in later attempts.
RELAXED = (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.16)


#: A packing in short: what a bin holds (length to pieces of it), and how many bins hold just that.
Bins = list[tuple[dict[int, int], int]]


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> Plan:
    """The packing of a histogram of lengths, each between 1 and `capacity`.

    Filling every bin to the brim can use up short pieces that long ones will lack. Unless no bin at all
    can be saved, it is tried again with some slack allowed, and then from a decreasing best fit whose
    loose bins are emptied and packed anew; the fewest bins are taken, never more than best fit's.
    """
    least = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
    best = packed_bins(counts, capacity, 0)
    for share in RELAXED:
        if number(best) <= least:
            break
        best = min(best, packed_bins(counts, capacity, int(share * capacity)), key=number)
    if number(best) > least:
        start = best_fit(counts, capacity)
        best = min(best, start, key=number)
        for share in (0.0, *RELAXED):
            tight = [(held, times) for held, times in start if capacity - weight(held) <= share * capacity]
            rest = dict(counts)
            for held, times in tight:
                for x, n in held.items():
                    rest[x] -= n * times
            best = min(best, tight + packed_bins(rest, capacity, int(share * capacity)), key=number)
    return laid_out(best)


def number(bins: Bins) -> int:
    return sum(times for _, times in bins)


def weight(held: dict[int, int]) -> int:
    return sum(x * n for x, n in held.items())


def packed_bins(counts: dict[int, int], capacity: int, slack: int) -> Bins:
    """One run: bin after bin the longest piece left and the fullest complement of it."""
    left = {k: int(v) for k, v in counts.items() if v}
    out: Bins = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        held = dict(Counter([longest, *fullest(rest, capacity - longest, slack)]))
        runs = min(left[x] // n for x, n in held.items())
        out.append((held, runs))
        for x, n in held.items():
            left[x] -= n * runs
            if not left[x]:
                del left[x]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Decreasing best fit, on classes of equal bins: pieces of one length go where the least room is left."""
    classes: dict[int, list[tuple[dict[int, int], int]]] = {}  # room left, to bins with it
    rooms: list[int] = []
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        many = counts[length]
        while many:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                held, times = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, held, times = capacity, {}, many
            per = min(room // length, many)
            taken = min(times, many // per)
            if taken < times and held:
                changed = [(held, times - taken, room)]
            else:
                changed = []
            changed.append((held | {length: per}, taken, room - per * length))
            many -= taken * per
            for what, n, free in changed:
                if free not in classes:
                    classes[free] = []
                    insort(rooms, free)
                classes[free].append((what, n))
    return [one for some in classes.values() for one in some]


def laid_out(bins: Bins) -> Plan:
    """The plan of a packing: bins numbered in order, in each the lengths in order."""
    given: dict[int, int] = {}
    rows: list[tuple[int, int, int, int, int, int]] = []
    first = 0
    for held, times in bins:
        offset = 0
        for x, n in held.items():
            start = given.get(x, 0)
            given[x] = start + n * times
            rows.append((x, start, given[x], first, n, offset))
            offset += n * x
        first += times
    rows.sort()
    return Plan(*np.array(rows, np.int64).reshape(-1, 6).T, first)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most `capacity` ids: id, piece, start, length, ids, crc, and part and nth.

    ids is binary, little-endian unsigned 32-bit; crc its CRC-32. part is the task, nth the piece's number among those
    of its length in that task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(tokenizer_path)
        part, counter = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        end = np.array([end_id], "<u4").tobytes()
        for b in row_slices(batches, rows=256, text=1):
            owner, piece, start, length, nth, crc, ids = [], [], [], [], [], [], []
            for i, coded in enumerate(words.ids(b.column(1).to_pylist())):
                coded += end
                n = len(coded) // 4
                for p, at in enumerate(range(0, n, capacity)):
                    upto = min(at + capacity, n)
                    owner.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(upto - at)
                    nth.append(counter[upto - at])
                    counter[upto - at] += 1
                    ids.append(coded[4 * at : 4 * upto])
                    crc.append(zlib.crc32(ids[-1]))
            longs = [pa.array(x, pa.int64()) for x in (start, length, nth, crc)]
            yield pa.record_batch([b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *longs, pa.array([part] * len(owner), pa.int32()), pa.array(ids, pa.binary())], names=["id", "piece", "start", "length", "nth", "crc", "part", "ids"])

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "nth": T.LongType(), "crc": T.LongType(), "part": T.IntegerType(), "ids": T.BinaryType()}
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), *(T.StructField(k, v) for k, v in kinds.items())]))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, most_offsets: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, piece, start, length, ids (binary), ids_crc32, sequence_id, offset.

    A document is its ids and then `end_id`; only documents longer than `capacity` are cut. Null texts
    are empty: `end_id` alone. Each row of `docs` is packed, repeated ones too; a null id stays null; an
    empty table gives an empty result; other columns are not read.

    Token ids are written once to the shared folder: a task numbers its pieces within their length as it
    writes them, and (task, length) counts give each task its first number. Those counts are broadcast up
    to `most_offsets` rows (some 80 bytes each in the join's table); beyond, the join shuffles the columns
    that the caller keeps: without `ids` some 60 bytes a piece, and the ids are not read again.
    The driver gets the histogram of lengths, at most `capacity` counts, and sends the plan back.
    """
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), compression="zstd")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = docs.sparkSession.sparkContext.broadcast(minimum_bin_slack(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if counts.limit(most_offsets + 1).count() <= most_offsets else base.hint("merge")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        bin_, offset = plan.value.place(length.to_numpy(np.int64), number.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": bin_, "offset": offset})

    placed = pieces.join(base, ["part", "length"]).withColumn("at", place("length", F.col("base") + F.col("nth")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids", F.col("crc").alias("ids_crc32"), "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of a packing: sequence_id, ids (binary), pieces. Shuffles the token ids once."""
    part = F.struct("offset", "ids", "length")
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.size("p").alias("pieces"))
