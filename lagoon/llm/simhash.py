"""SimHash near-duplicates: word-shingle fingerprints, tiled exact comparison, components.

Fingerprints are reduced to the distinct ones first. Two that differ in at most r of 64 bits agree on
at least m - r of m equal lanes, so every linked pair meets in a block keyed by some m - r lanes; a
block is compared exactly, tile by tile, with numpy's exclusive-or and bit counts, and tiles whose
population counts differ by more than r are skipped. Every m gives the same links; m only sets how
many candidates a block holds. Huge blocks are split by further bits, large ones cut by population count and salt into tile pairs, so no
task holds one whole. A tile pair returns a spanning forest of its links, never all of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagoon.llm.common import keep_rows, materialise, row_slices, text_or_empty

BITS = 64


def fingerprint(text: str, words: int = 3, seed: int = 42, block: int = 200_000) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's word shingles.

    Words are what ASCII white space leaves, A-Z lower-cased; fewer than `words` words make one
    shingle of them all, none gives 0. Repeated shingles count each time.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(found) - words + 1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, block):
        part = found[at : min(at + block, n) + words - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[i:] for i in range(words)), strict=False))
        h = np.fromiter((h64(g, seed) for g in grams), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's 64 bits as a signed long. Null texts are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in row_slices(batches, rows=512, text=1):
            fp = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], names=["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, T.StructType([T.StructField("id", slim.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def lane_count(distinct: int, radius: int, dense: int = 2048) -> int:
    """Fewest lanes for which a block of uniform fingerprints would hold at most `dense` of them."""
    for lanes in range(radius + 1, 13):
        if distinct / 2 ** (BITS * (lanes - radius) // lanes) <= dense:
            return lanes
    return 12


def block_keys(fp: Column, lanes: int, radius: int) -> Column:
    """Array of the keys of each choice of lanes - radius lanes: the choice's number and its bits."""
    edges = [BITS * i // lanes for i in range(lanes + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(lanes), lanes - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")))
    return F.array(*keys)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def finer_masks(lanes: int, radius: int) -> list[list[int]]:
    """For each choice of lanes the masks that split its blocks further.

    Within a block all differences lie in the lanes not chosen. Their bits go to radius + 3 groups; a pair
    agrees on at least 3 of them, so it meets again under the chosen lanes and some 3 groups.
    """
    edges = [BITS * i // lanes for i in range(lanes + 1)]
    out = []
    for chosen in combinations(range(lanes), lanes - radius):
        base = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        free = [b for b in range(BITS) if not base >> b & 1]
        groups = [sum(1 << b for b in free[len(free) * g // (radius + 3) : len(free) * (g + 1) // (radius + 3)]) for g in range(radius + 3)]
        out.append([signed(base | sum(some)) for some in combinations(groups, 3)])
    return out


def split_blocks(keyed: DataFrame, most: int, lanes: int, radius: int) -> DataFrame:
    """`keyed` (fp, choice, bits) with the rows of blocks of more than `most` dealt to finer blocks.

    A row of such a block gets 20 keys (at radius 3), however large the block is; dealt to tiles it would
    get a number that grows with the block.
    """
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n"))
    huge = materialise(sizes.where(F.col("n") > most).select("choice", "bits"))
    n = huge.limit(200_001).count()
    if not n:
        return keyed
    side = F.broadcast(huge) if n <= 200_000 else huge.hint("merge")
    masks = F.from_json(F.lit(json.dumps(finer_masks(lanes, radius))), "array<array<bigint>>")
    inside = keyed.join(side, ["choice", "bits"], "left_semi")
    finer = F.transform(masks[F.col("choice")], lambda m, i: F.struct((1000 + F.col("choice") * 100 + i).alias("choice"), F.col("fp").bitwiseAND(m).alias("bits")))
    return keyed.join(side, ["choice", "bits"], "left_anti").select("fp", "choice", "bits").union(inside.select("fp", F.explode(finer).alias("k")).select("fp", "k.choice", "k.bits"))


def forest(left: np.ndarray, right: np.ndarray, radius: int, same: bool, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger) that join what is within `radius` between two sets, or within one.

    Both are sorted by population count; tile pairs whose counts differ by more than the radius are
    not compared. Of the links only those that join two trees of a union-find forest are kept.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def by_count(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.bitwise_count(x)
        order = np.argsort(c, kind="stable")
        return x[order], c[order].astype(np.int64)

    (a, ca), (b, cb) = by_count(left), by_count(right)
    out: list[tuple[int, int]] = []
    for i in range(0, len(a), tile):
        low, high = ca[i], ca[min(i + tile, len(a)) - 1]
        first = np.searchsorted(cb, low - radius)
        last = np.searchsorted(cb, high + radius, side="right")
        for j in range(max(first, i) if same else first, last, tile):
            x, y = a[i : i + tile], b[j : min(j + tile, last)]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            p, q = np.nonzero(near)
            for u, v in zip(x[p].tolist(), y[q].tolist(), strict=True):
                if u != v and (ru := root(u)) != (rv := root(v)):
                    parent[max(ru, rv)] = min(ru, rv)
                    out.append((u, v) if u < v else (v, u))
    return np.array([u for u, _ in out], np.uint64), np.array([v for _, v in out], np.uint64)


def near_links(distinct: DataFrame, radius: int = 3, tile_rows: int = 1024, split_rows: int = 16_384) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of `fp` within `radius` bits.

    distinct: materialised, one row per fingerprint, column fp. Blocks of over `split_rows` are split by
    further bits, those that still have over `tile_rows` are cut into tiles.
    """
    n = distinct.count()
    lanes = lane_count(n, radius)
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), lanes, radius)).alias("k")).select("fp", "k.choice", "k.bits")
    keyed = split_blocks(keyed, split_rows, lanes, radius)
    sizes = keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large = materialise(sizes.where(F.col("n") > tile_rows))
    hot = F.broadcast(large) if large.limit(200_001).count() <= 200_000 else large.hint("merge")
    tiled = keyed.join(hot, ["choice", "bits"], "left")
    # a large block: tiles by population count and salt; each meets those of the counts up to `radius` above
    count = F.bit_count("fp").cast("int")
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / (4.0 * tile_rows))).cast("int")
    salt = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), salts)).cast("int")
    small = F.array(F.struct(F.lit(-1).alias("count"), F.lit(0).alias("up"), F.lit(0).alias("s"), F.lit(0).alias("t"), F.lit(True).alias("first"), F.lit(True).alias("second")))
    others = F.sequence(F.lit(0), salts - 1)

    def pair(base: Column, up: Column, mine: Column, other: Column, first: bool) -> Column:
        s, t = (mine, other) if first else (other, mine)
        same = (up == 0) & (mine == other)
        return F.struct(base.cast("int").alias("count"), up.cast("int").alias("up"), s.cast("int").alias("s"), t.cast("int").alias("t"), (F.lit(first) | same).alias("first"), (F.lit(not first) | same).alias("second"))

    ups = F.sequence(F.lit(0), F.lit(radius))
    as_first = F.flatten(F.transform(ups, lambda up: F.transform(F.filter(others, lambda o: (up > 0) | (o >= F.col("salt"))), lambda o: pair(F.col("c"), up, F.col("salt"), o, True))))
    as_second = F.flatten(F.transform(ups, lambda up: F.transform(F.filter(others, lambda o: (up > 0) | (o < F.col("salt"))), lambda o: pair(F.col("c") - up, up, F.col("salt"), o, False))))
    dealt = tiled.withColumn("salt", salt).withColumn("c", count).select("fp", "choice", "bits", F.explode(F.when(F.col("n").isNull(), small).otherwise(F.concat(as_first, as_second))).alias("p"))
    groups = ["choice", "bits", "count", "up", "s", "t"]
    cells = dealt.select("fp", "choice", "bits", "p.*")
    blocks = cells.groupBy(*groups).agg(F.collect_list(F.when(F.col("first"), F.col("fp"))).alias("left"), F.collect_list(F.when(F.col("second"), F.col("fp"))).alias("right"))
    # a cell that meets itself has each fingerprint on both sides, and needs two of them; any other one a side
    itself = (F.col("up") == 0) & (F.col("s") == F.col("t"))
    blocks = blocks.where((F.size("left") > 0) & (F.size("right") > 0) & (~itself | (F.size("left") > 1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up, s, t = (batch.column(i).to_numpy() for i in range(3))
            left, right = batch.column(3), batch.column(4)
            some: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(batch.num_rows):
                x, y = (np.asarray(c[i].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for c in (left, right))
                some.append(forest(x, y, radius, bool(up[i] == 0 and s[i] == t[i])))
            if some:
                a, b = (np.concatenate([p[k] for p in some]).view(np.int64) for k in (0, 1))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    links = blocks.select("up", "s", "t", "left", "right").mapInArrow(compare, "a bigint, b bigint")
    return links


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node it reaches.

    Alternating large-star and small-star steps: each is one aggregation and one join on the edges,
    and no step gathers a node's neighbours in one place. Ends when the edges are stars that no
    longer change. links: columns a, b of a long each.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u go to the least of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: neighbours below u, and u itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.where("u <> v").distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over fingerprints that differ in at most `radius` bits,
    the row's own included. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows and repeated ids stay; a null id is no candidate for component_id, which is null
    only if the whole component has null ids. An empty table gives an empty result. Other columns of
    `docs` are not read.

    One pass over the texts; everything after works on 16 bytes a row, exact copies collapse in a
    map-side aggregation, and a hot fingerprint in the last join is split by AQE.
    """
    each = materialise(fingerprints(docs, words, seed, id_col, text_col))
    least = materialise(each.groupBy("fp").agg(F.min("id").alias("least")))
    linked = materialise(components(near_links(least.select("fp"), radius)))
    reached = linked.join(least, linked["node"] == least["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = linked.join(reached, "root").select(F.col("node").alias("fp"), "component_id")
    # materialised, so that both sides of the last join are exchanges and AQE can split a hot fingerprint
    by_fp = materialise(least.join(by_node, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    out = each.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id is their component's smallest; of rows that repeat an id, one.

    Which of several rows with one id stays is arbitrary. Rows with a null id go if a row of their
    component has an id, and stay otherwise. All columns stay as they are.

    Only ids travel: the dropped ones are broadcast if counting shows they are few, else joined.
    """
    found = materialise(near_duplicates(docs.select(id_col, text_col), words, seed, radius, id_col, text_col))
    by_id = materialise(found.groupBy(id_col).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"))
    kept = keep_rows(docs, by_id.where("not stays").select(id_col), id_col, anti=True)
    if found.where(F.col(id_col).isNull() & F.col("component_id").isNotNull()).limit(1).count():
        # null ids cannot be joined by: those rows are looked up by their fingerprint, which has one component
        gone = materialise(found.where(F.col(id_col).isNull() & F.col("component_id").isNotNull()).select(F.col("fingerprint").alias("__fp")).distinct())

        @F.pandas_udf(T.StringType())
        def hexed(texts: pd.Series) -> pd.Series:
            return pd.Series([f"{fingerprint(t, words, seed):016x}" for t in texts], dtype="object")

        nameless = kept.where(F.col(id_col).isNull()).withColumn("__fp", hexed(text_or_empty(text_col)))
        kept = kept.where(F.col(id_col).isNotNull()).unionByName(keep_rows(nameless, gone, "__fp", anti=True).drop("__fp"))
    repeated = by_id.where("stays and n > 1").select(id_col)
    if repeated.limit(1).count():
        kept = keep_rows(kept, repeated, id_col, anti=True).unionByName(keep_rows(kept, repeated, id_col).dropDuplicates([id_col]))
    return kept
