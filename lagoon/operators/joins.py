"""Joins: as-of, interval, scoped, checked, containment, similarity and near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.functions.exprs import dot, jaccard


class CardinalityError(ValueError):
    pass


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a key repeats; stops at the first found."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise CardinalityError(f"{what} repeats a key of {list(keys)}")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose sides are checked first: one_to_one, many_to_one, one_to_many or many_to_many."""
    of_left, of_right = validate.split("_to_")
    if of_left == "one":
        assert_unique(left, keys, "the left side")
    if of_right == "one":
        assert_unique(right, keys, "the right side")
    return left.join(right, list(keys), how)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, cols: Sequence[str], tie: Sequence[str] = (), exact: bool = True, age: str | None = None) -> DataFrame:
    """Each left row with `cols` of the last right row of its key at or before its time (before, if not exact).

    One union, one exchange on the keys, one sort and a running last value: linear in both sides, with no
    inequality join. Of right rows at one time the last by `tie` counts. age: days between the two.
    """
    names = [c for c in left.columns]
    payload = F.struct(F.col(right_time).alias("__t"), *[F.col(c) for c in cols])
    r = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__at"), F.lit(0 if exact else 2).alias("__side"), payload.alias("__p"), *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie)])
    l_ = left.select(*keys, F.col(left_time).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__p"].dataType).alias("__p"), *[F.lit(None).cast(r.schema[f"__tie{i}"].dataType).alias(f"__tie{i}") for i, _ in enumerate(tie)], F.struct(*names).alias("__row"))
    both = l_.unionByName(r.withColumn("__row", F.lit(None).cast(l_.schema["__row"].dataType)))
    w = Window.partitionBy(*keys).orderBy("__at", "__side", *[f"__tie{i}" for i, _ in enumerate(tie)]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__last", F.last("__p", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    picked = [F.col(f"__last.{c}").alias(c) for c in cols]
    extra = [F.date_diff(F.col("__row")[left_time], F.col("__last.__t")).alias(age)] if age else []
    return out.select(*[F.col("__row")[c].alias(c) for c in names], *picked, *extra)


def open_interval(at: Column, begin: Column, end: Column, blank_is_open: bool = False) -> Column:
    """begin <= at <= end with missing bounds open; blank text too, if so said."""
    if blank_is_open:
        begin, end = F.nullif(F.trim(begin), F.lit("")), F.nullif(F.trim(end), F.lit(""))
    return (begin.isNull() | (begin.cast("date") <= at)) & (end.isNull() | (at <= end.cast("date")))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, bucket_days: int = 365, how: str = "inner") -> DataFrame:
    """Rows whose date lies in the right row's validity interval, on equal keys.

    With keys it is an equi-join with a range filter. Without keys the date axis is cut into buckets and
    intervals are spread over those they touch, so it is an equi-join too; an interval open on one side is
    bounded by the left side's own dates.
    """
    cond = open_interval(F.col(at).cast("date"), F.col(begin), F.col(end))
    if keys:
        r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__r_{k}") for k in keys]) & cond
        return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])
    bounds = left.agg(F.min(F.col(at).cast("date")).alias("__lo"), F.max(F.col(at).cast("date")).alias("__hi"))
    number = lambda d: F.floor(F.unix_date(d) / F.lit(bucket_days))
    spread = right.join(F.broadcast(bounds)).withColumn("__b0", F.greatest(F.coalesce(F.col(begin).cast("date"), F.col("__lo")), F.col("__lo"))).withColumn("__b1", F.least(F.coalesce(F.col(end).cast("date"), F.col("__hi")), F.col("__hi")))
    spread = spread.where("__b0 <= __b1").withColumn("__bucket", F.explode(F.sequence(number(F.col("__b0")), number(F.col("__b1"))))).drop("__lo", "__hi", "__b0", "__b1")
    l_ = left.withColumn("__bucket", number(F.col(at).cast("date")))
    return l_.join(spread.withColumnRenamed("__bucket", "__rb"), (F.col("__bucket") == F.col("__rb")) & cond, how).drop("__bucket", "__rb")


def scoped_join(panel: DataFrame, features: DataFrame, date: str, scope_keys: dict[str, str | None], scope: str, entity: str, cols: Sequence[str], feature_date: str) -> DataFrame:
    """Feature blocks of several scopes joined by (date, entity) as scope__column, zero where missing.

    scope_keys: scope to the panel's column that holds its entity; None for a scope of the whole market.
    A key that repeats in a scope is an error.
    """
    assert_unique(features, [feature_date, scope, entity], "the feature table")
    out = panel
    for name, key in scope_keys.items():
        block = features.where(F.col(scope) == name).select(F.col(feature_date).alias("__d"), F.col(entity).alias("__e"), *[F.col(c).alias(f"{name}__{c}") for c in cols])
        on = F.col(date) == F.col("__d")
        if key is not None:
            on = on & (F.col(key) == F.col("__e"))
        out = out.join(block, on, "left").drop("__d", "__e").na.fill(0.0, [f"{name}__{c}" for c in cols])
    return out


def first_token(x: Column | str) -> Column:
    return F.split(x, " ")[0]


def normalise_alias(x: Column | str) -> Column:
    """Lower-case letters and digits as single-spaced tokens."""
    return F.array_join(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def containment_join(texts: DataFrame, text: str, aliases: DataFrame, alias: str, keep: Sequence[str], most: int = 1000) -> DataFrame:
    """(text row, alias row) pairs where the alias stands in the text on token borders.

    The tokens of a text meet the aliases that begin with one; only those pairs are verified. keep: the
    text columns to carry. Up to `most` first tokens, of 100 x `most` aliases, go into the plan: a text is
    repeated in memory for those of them that it has, and nothing is shuffled. Beyond, tokens meet the
    aliases with the digest of their text only, and the texts are shuffled once.
    """
    t = texts.withColumn("__norm", F.concat(F.lit(" "), normalise_alias(text), F.lit(" "))).select(*keep, "__norm")
    tokens = F.array_distinct(F.split(F.trim("__norm"), " "))
    a = aliases.withColumn("__alias", normalise_alias(alias)).where("__alias <> ''").withColumn("__first", first_token(F.col("__alias")))
    inside = F.col("__norm").contains(F.concat(F.lit(" "), F.col("__alias"), F.lit(" ")))
    firsts = {r["__first"]: r["count"] for r in a.groupBy("__first").count().limit(most + 1).collect()}
    if len(firsts) <= most and sum(firsts.values()) <= 100 * most:
        few = F.array(*[F.lit(x) for x in sorted(firsts)]).cast("array<string>")
        hit = t.withColumn("__token", F.explode(F.array_intersect(tokens, few))).join(F.broadcast(a), F.col("__token") == F.col("__first"))
    else:
        t = t.withColumn("__digest", F.sha2("__norm", 256))
        found = t.select("__digest", F.explode(tokens).alias("__token")).distinct()
        hit = t.join(found.join(a, F.col("__token") == F.col("__first")), "__digest").drop("__digest")
    return hit.where(inside).drop("__norm", "__token", "__first")


def resolve_names(names: DataFrame, name: str, entities: DataFrame, entity: str, label: str, ignored: Sequence[str], least_jaccard: float = 0.6, least_tokens: int = 2) -> DataFrame:
    """name, entity, how: a unique exact match, else a unique one by containment and token overlap; others absent."""
    toks = lambda c: F.array_except(F.array_distinct(F.split(normalise_alias(c), " ")), F.array(*[F.lit(x) for x in ignored]))
    n = names.select(F.col(name).alias("name")).distinct().withColumns({"norm": normalise_alias("name"), "t": toks("name")})
    e = entities.select(F.col(entity).alias("entity"), normalise_alias(label).alias("enorm"), toks(label).alias("et")).distinct()
    exact = n.join(e, n["norm"] == e["enorm"]).groupBy("name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity"))
    sure = exact.where("n = 1").select("name", "entity", F.lit("exact").alias("how"))
    rest = n.join(exact, "name", "left_anti")
    pairs = rest.withColumn("tok", F.explode("t")).join(e.withColumn("etok", F.explode("et")), F.col("tok") == F.col("etok")).select("name", "t", "entity", "et").distinct()
    inside = (F.size(F.array_except("t", "et")) == 0) | (F.size(F.array_except("et", "t")) == 0)
    fuzzy = pairs.where(inside & (F.least(F.size("t"), F.size("et")) >= least_tokens) & (jaccard("t", "et") >= least_jaccard))
    fuzzy = fuzzy.groupBy("name").agg(F.count_distinct("entity").alias("n"), F.min("entity").alias("entity")).where("n = 1")
    return sure.unionByName(fuzzy.select("name", "entity", F.lit("fuzzy").alias("how")))


def similarity_pairs(df: DataFrame, key: str, group: str, vector: str, title_tokens: str | None, high: float, low: float = 2.0, least_jaccard: float = 2.0, bucket: int = 256) -> DataFrame:
    """Pairs of a group with inner product >= high, or >= low and title overlap >= least_jaccard.

    All pairs of a group must be compared; a group is dealt into buckets by hash and pairs of buckets go to
    different tasks, so no task holds a large group. left < right.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    v = df.select(F.col(group), F.col(key), F.col(vector).alias("__v"), *([F.col(title_tokens).alias("__t")] if title_tokens else []))
    v = v.join(sizes, group).withColumn("__k", F.ceil(F.col("__n") / F.lit(bucket))).withColumn("__s", F.pmod(F.xxhash64(key), F.col("__k")))
    cols = ["__v", *(["__t"] if title_tokens else [])]
    a = v.select(F.col(group), F.col(key).alias("left"), F.col("__s").alias("__x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1)).alias("__y"), *[F.col(c).alias(c + "a") for c in cols])
    b = v.select(F.col(group), F.col(key).alias("right"), F.col("__s").alias("__y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1)).alias("__x"), *[F.col(c).alias(c + "b") for c in cols])
    pairs = a.join(b, [group, "__x", "__y"]).where(F.col("left") < F.col("right")).withColumn("score", dot("__va", "__vb"))
    close = F.col("score") >= high
    if title_tokens:
        close = close | ((F.col("score") >= low) & (jaccard("__ta", "__tb") >= least_jaccard))
    return pairs.where(close).select(group, "left", "right", "score")


def similarity_forest(df: DataFrame, key: str, group: str, vector: str, high: float, bucket: int = 2048) -> DataFrame:
    """(left, right) links between vectors of a group whose inner product is >= high: enough to connect all that any such pair does.

    As `similarity_pairs` compares all pairs of a group in pairs of buckets, but each pair of buckets is one matrix
    product, and returns a spanning forest of its links instead of all. Products within rounding of
    the bound are added up again in the order of `dot`, so no link is lost or made. NULL vectors and
    vectors with NULLs, or of another length, have no links.
    """
    v = df.select(F.col(group).alias("__g"), F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__v"))
    v = v.where(F.col("__g").isNotNull() & F.col("__v").isNotNull() & ~F.exists("__v", lambda x: x.isNull())).withColumn("__d", F.size("__v"))
    sizes = v.groupBy("__g", "__d").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket)).alias("__k"))
    v = v.join(sizes, ["__g", "__d"]).withColumn("__s", F.pmod(F.xxhash64("__key"), F.col("__k")))
    v = v.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1)))
    v = v.select("__g", "__d", F.least("__s", "__t").alias("__x"), F.greatest("__s", "__t").alias("__y"), (F.col("__s") <= F.col("__t")).alias("__low"), (F.col("__s") >= F.col("__t")).alias("__high"), "__key", "__v")

    def links(tile: pa.Table) -> pa.Table:
        width = tile.column("__d")[0].as_py()
        keys = tile.column("__key").combine_chunks()
        data = tile.column("__v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        a, b = (np.flatnonzero(tile.column(c).to_numpy(zero_copy_only=False)) for c in ("__low", "__high"))
        left, right = spanning_links(data[a], data[b], high)
        return pa.table({"left": keys.take(pa.array(a[left])), "right": keys.take(pa.array(b[right]))})

    kind = v.schema["__key"].dataType.simpleString()
    return v.groupBy("__g", "__d", "__x", "__y").applyInArrow(links, f"left {kind}, right {kind}").where(F.col("left") != F.col("right"))


def spanning_links(a: np.ndarray, b: np.ndarray, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b in a spanning forest of the links between them, products >= high; NaN is above all."""
    with np.errstate(all="ignore"):
        score = a @ b.T
        doubt = 1e-15 * (a.shape[1] + 8) * np.outer(np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1)))
        i, j = np.nonzero(~(np.abs(score - high) > doubt))
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            total = np.zeros(len(p))
            for k in range(a.shape[1]):
                total += a[p, k] * b[q, k]
            score[p, q] = total
    linked = ~(score < high)
    left, right = [], []
    waiting_a, waiting_b = linked.any(1), np.ones(len(b), bool)
    for root in np.flatnonzero(waiting_a):
        if not waiting_a[root]:
            continue
        rows, waiting_a[root] = np.array([root]), False
        while len(rows):
            some = linked[rows] & waiting_b
            cols = np.flatnonzero(some.any(0))
            left.append(rows[some[:, cols].argmax(0)])
            right.append(cols)
            waiting_b[cols] = False
            some = linked[:, cols] & waiting_a[:, None]
            rows = np.flatnonzero(some.any(1))
            left.append(rows)
            right.append(cols[some[rows].argmax(1)] if len(rows) else rows)
            waiting_a[rows] = False
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def band_pairs(df: DataFrame, key: str, fingerprint: str, size: str, bands: int = 4, radius: int = 3, least_ratio: float = 0.85) -> DataFrame:
    """Near-duplicate pairs (key, lower key): an equal band of the fingerprint, few differing bits, like sizes.

    Equal fingerprints are compared once: the join is on distinct (fingerprint, size) with their least key.
    """
    width = 64 // bands
    d = df.groupBy(F.col(fingerprint).alias("__f"), F.col(size).alias("__n")).agg(F.min(key).alias("__key"))
    band = F.posexplode(F.array(*[F.shiftrightunsigned("__f", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)]))
    e = d.select("*", band.alias("__band", "__bits"))
    a, b = e.alias("a"), e.alias("b")
    near = (F.bit_count(F.col("a.__f").bitwiseXOR(F.col("b.__f"))) <= radius) & (F.least("a.__n", "b.__n") >= least_ratio * F.greatest("a.__n", "b.__n"))
    hit = a.join(b, (F.col("a.__band") == F.col("b.__band")) & (F.col("a.__bits") == F.col("b.__bits")) & (F.col("b.__key") < F.col("a.__key"))).where(near)
    return hit.select(F.col("a.__key").alias(key), F.col("b.__key").alias("lower")).distinct()


def band_classes(df: DataFrame, key: str, fingerprint: str, size: str) -> DataFrame:
    """(key, representative): the least key of the same fingerprint and size, the one that `band_pairs` compares."""
    least = df.groupBy(F.col(fingerprint).alias("__f"), F.col(size).alias("__n")).agg(F.min(key).alias("representative"))
    d = df.select(key, F.col(fingerprint).alias("__f"), F.col(size).alias("__n"))
    return d.join(least, ["__f", "__n"]).select(key, "representative")
