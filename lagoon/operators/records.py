"""Records of events, runs and entities: immutable rows, ledgers, candidates, dates, exports, contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagoon.operators.models import grams


class ConflictError(ValueError):
    pass


def immutable_upsert(stored: DataFrame, new: DataFrame, key: str, order: str, fixed: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Stored rows and new ones, a row per key: the first version's `kept` columns stay; `fixed` may never change.

    A key whose versions differ in a fixed column is an error (when the result is read). Stored rows come
    before new ones, those by `order`. One aggregation with map-side combination.
    """
    both = stored.select(key, order, *fixed, *kept, F.lit(0).alias("__new")).unionByName(new.select(key, order, *fixed, *kept, F.lit(1).alias("__new")))
    first = F.min_by(F.struct(order, *fixed, *kept), F.struct("__new", order)).alias("__row")
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in fixed]) if fixed else F.lit(0)
    one = both.groupBy(key).agg(first, F.min(digest).alias("__lo"), F.max(digest).alias("__hi"))
    checked = F.when(F.col("__lo") == F.col("__hi"), F.col("__row")).otherwise(F.raise_error(F.concat(F.lit("changed fixed columns of "), F.col(key).cast("string"))))
    return one.select(key, checked.alias("__row")).select(key, *[F.col("__row")[c].alias(c) for c in (order, *fixed, *kept)])


def reusable(work: DataFrame, contexts: DataFrame, keys: Sequence[str], cutoff: str, payload: Sequence[str]) -> DataFrame:
    """Work rows with the payload of an earlier context of the same keys and the very same cutoff; NULL otherwise."""
    c = contexts.select(*keys, F.col(cutoff).alias("__cutoff"), *payload)
    same = F.col(cutoff) == F.col("__cutoff")
    return work.join(c, list(keys), "left").withColumns({p: F.when(same, F.col(p)) for p in payload}).drop("__cutoff")


def ledger(opened: DataFrame, closed: DataFrame, run: str) -> DataFrame:
    """Run rows with status `open`, or what the last closing row says: (run, columns of opened, status, finished_at)."""
    end = closed.groupBy(run).agg(F.max_by("status", "finished_at").alias("status"), F.max("finished_at").alias("finished_at"))
    return opened.join(end, run, "left").withColumn("status", F.coalesce("status", F.lit("open")))


def failures(attempts: DataFrame, keys: Sequence[str], order: str, error: str) -> DataFrame:
    """Keys whose last attempt failed: attempts so far since the last success, and the last error."""
    good = F.col(error).isNull()
    last_good = F.max(F.when(good, F.col(order)))
    one = attempts.groupBy(*keys).agg(last_good.alias("__good"), F.max(order).alias("last"), F.max_by(error, order).alias(error)).where(F.col(error).isNotNull())
    later = attempts.join(one.select(*keys, "__good"), list(keys)).where(F.col("__good").isNull() | (F.col(order) > F.col("__good")))
    return one.drop("__good").join(later.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts")), list(keys))


def ticker_candidates(df: DataFrame, key: str, payload: str, known: DataFrame, entity: str, sector: str, reason: str, sure: float = 0.99, inherited: float = 0.65) -> DataFrame:
    """(key, scope, entity, confidence, reason) from a JSON array of symbols: known ones, and each sector of theirs once.

    Symbols are trimmed and upper-cased. A sector's reason names the first symbol that gives it.
    """
    each = df.select(key, F.explode(F.from_json(payload, "array<string>")).alias("__s")).select(key, F.upper(F.trim("__s")).alias("__s")).where("__s <> ''").distinct()
    hit = each.join(known.select(F.col(entity).alias("__s"), F.col(sector).alias("__sector")), "__s")
    symbols = hit.select(key, F.lit("ticker").alias("scope"), F.col("__s").alias("entity"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason"))
    sectors = hit.where("__sector is not null and __sector <> ''").groupBy(key, "__sector").agg(F.min("__s").alias("__s"))
    return symbols.unionByName(sectors.select(key, F.lit("sector").alias("scope"), F.col("__sector").alias("entity"), F.lit(inherited).alias("confidence"), F.concat(F.lit("inherited from "), F.col("__s")).alias("reason")))


def article_dates(articles: DataFrame, events: DataFrame, key: str, canonical: str, effective: str, event_date: str) -> DataFrame:
    """(canonical key, date): the canonical article's effective date, else its copies' earliest event."""
    whole = F.coalesce(canonical, key)
    own = articles.where(F.col(key) == whole).select(F.col(key).alias("article"), F.to_date(effective).alias("__own"))
    seen = events.join(articles.select(key, whole.alias("article")), key).groupBy("article").agg(F.min(F.to_date(event_date)).alias("__seen"))
    return own.join(seen, "article", "full_outer").select("article", F.coalesce("__own", "__seen").alias("date")).where("date is not null")


def first_title(documents: Column, fallback: Column, most: int = 500) -> Column:
    """The first non-blank title of an array of structs with a `title`, cut to `most`; else the fallback."""
    titled = F.filter(documents, lambda d: d["title"].isNotNull() & (d["title"] != ""))
    return F.coalesce(F.left(F.get(titled, F.lit(0))["title"], F.lit(most)), fallback)


def union_by_priority(first: DataFrame, second: DataFrame, day: str, url: str) -> DataFrame:
    """All of the first feed, and of the second each (day, url) the first does not have that day."""
    return first.unionByName(second.join(first.select(day, url).distinct(), [day, url], "left_anti"))


def ranked_ids(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Distinct keys in the order of their first rank: (key, rank)."""
    return df.groupBy(key).agg(F.min(rank).alias(rank)).orderBy(rank, key)


def exported(df: DataFrame, keys: Sequence[str], payload: str, names: Sequence[str]) -> DataFrame:
    """Keys and the named numbers of a JSON object, in the keys' order; a name it lacks is NULL."""
    s = F.from_json(payload, ", ".join(f"`{n}` double" for n in names))
    return df.select(*keys, s.alias("__s")).select(*keys, *[F.col("__s")[n].alias(n) for n in names]).orderBy(*keys)


def availability(df: DataFrame, filings: DataFrame, accession: str, filed: str, accepted: str, quality: str, close: str = "23:59:59") -> DataFrame:
    """Rows with available_at and its quality: the filing's acceptance, else the end of the day it was filed on."""
    f = filings.select(accession, F.col(accepted).alias("__at"), F.col(quality).alias("__q"))
    fallback = F.to_timestamp(F.concat(F.date_format(F.to_date(filed), "yyyy-MM-dd"), F.lit(f" {close}")))
    return df.join(f, accession, "left").withColumns({"available_at": F.coalesce(F.col("__at").cast("timestamp"), fallback), "available_quality": F.coalesce("__q", F.lit("end_of_day"))}).drop("__at", "__q")


def universe(df: DataFrame, symbol: str) -> DataFrame:
    """Distinct symbols, trimmed and in capitals."""
    return df.select(F.upper(F.trim(F.col(symbol).cast("string"))).alias("symbol")).where("symbol <> ''").distinct()


def parse_series(argument: str) -> dict[str, str]:
    """ID=title pairs separated by commas; an id without a title is its own."""
    pairs = [x.strip().partition("=") for x in argument.split(",") if x.strip()]
    return {k.strip(): v.strip() or k.strip() for k, _, v in pairs}


def signature(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: rows, and an order-free digest of the columns: the sum of the rows' hashes. Equal inputs have equal ones."""
    h = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def check_contract(found: dict, frozen: dict) -> None:
    """Raise with all differences between a run's parameters and the frozen ones; numbers within 1e-12 are equal."""
    same = lambda a, b: abs(a - b) <= 1e-12 if isinstance(a, float) and isinstance(b, (int, float)) else a == b
    wrong = sorted(k for k in found.keys() | frozen.keys() if k not in found or k not in frozen or not same(found[k], frozen[k]))
    if wrong:
        raise ConflictError(f"contract differs in {wrong}")


def feature_set(groups: dict[str, Sequence[str]], mode: str) -> list[str]:
    """Columns of an ablation: `a+b` names groups in order; a column is taken once."""
    unknown = [g for g in mode.split("+") if g not in groups]
    if unknown:
        raise ValueError(f"unknown groups {unknown}; there are {sorted(groups)}")
    return list(dict.fromkeys(c for g in mode.split("+") for c in groups[g]))


def ridge_probes(df: DataFrame, features: Sequence[str], targets: Sequence[str], train: Column, alpha: float, prefix: str = "predicted_") -> DataFrame:
    """The table with a prediction of every target by ridge on standardised features, all fitted in one pass.

    Sums of products of (1, features, targets) over training rows with all targets come to the driver:
    (1 + features + targets)^2 numbers. Missing features are 0; a constant feature has no weight.
    """
    import numpy as np

    whole = df.where(train & F.col(targets[0]).isNotNull())
    for t in targets[1:]:
        whole = whole.where(F.col(t).isNotNull())
    found = grams(whole.withColumns({"__fold": F.lit(0), "__zero": F.lit(0.0)}), "__fold", [*features, *targets], "__zero")
    if not found:
        return df.withColumns({f"{prefix}{t}": F.lit(None).cast("double") for t in targets})
    g, k = found[0][:-1, :-1], len(features)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(centred)[:k] / n, 0.0))
    live = sd > 1e-12
    scale = np.where(live, 1 / np.where(live, sd, 1.0), 0.0)
    xx = centred[:k, :k] * np.outer(scale, scale)
    beta = np.linalg.solve(xx + alpha * np.eye(k), centred[:k, k:] * scale[:, None]) * scale[:, None]
    made = {}
    for j, t in enumerate(targets):
        out = F.lit(float(mean[k + j] - mean[:k] @ beta[:, j]))
        for i, f in enumerate(features):
            out = out + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(float(beta[i, j]))
        made[f"{prefix}{t}"] = out
    return df.withColumns(made)


def latest_scores(df: DataFrame, key: str, time: str, features: Sequence[str], intercept: float, beta: Sequence[float]) -> DataFrame:
    """Each key's last row scored by a linear model, ranked within the table: key, time, prediction, rank."""
    w = Window.partitionBy(key).orderBy(F.col(time).desc())
    last = df.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    out = F.lit(float(intercept))
    for f, b in zip(features, beta, strict=True):
        out = out + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(float(b))
    scored = last.select(key, time, out.alias("prediction"))
    return scored.withColumn("rank", F.rank().over(Window.orderBy(F.col("prediction").desc(), key)))
