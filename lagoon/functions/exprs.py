"""ANSI-safe scalar expressions. Missing is NULL throughout: NaN and infinities become NULL at the boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NaN and infinite values as NULL."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bounds that keep NULL: greatest and least alone would skip it."""
    x = _c(x)
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL for b = 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_ratio(a: Column | str, b: Column | str, low: float = -10.0, high: float = 10.0) -> Column:
    """a over the size of b, NULL for b = 0, within bounds."""
    return clip(ratio(a, F.abs(_c(b))), low, high)


def symmetric_change(a: Column | str, b: Column | str, bound: float = 2.0) -> Column:
    """2 (a - b) / (|a| + |b|), within bounds."""
    a, b = _c(a), _c(b)
    return clip(ratio(2 * (a - b), F.abs(a) + F.abs(b)), -bound, bound)


def saturating(x: Column | str, full: float = 5.0) -> Column:
    """min(x, full) / full for counts."""
    return clip(_c(x).cast("double"), 0.0, full) / F.lit(full)


def null_tokens(x: Column | str, tokens: tuple[str, ...] = ("", "none", "null", "nan", "n/a", "-", ".")) -> Column:
    """Text whose trimmed lower case is a missing marker becomes NULL."""
    x = F.trim(_c(x))
    return F.when(~F.lower(x).isin(*tokens), x)


def optional_number(x: Column | str) -> Column:
    """A number from text with thousands separators and missing markers; NULL if it is none."""
    return finite(F.regexp_replace(null_tokens(x), ",", "").try_cast("double"))


def optional_bool(x: Column | str) -> Column:
    """1, true, yes, y to true; 0, false, no, n to false; else NULL."""
    x = F.lower(F.trim(_c(x)))
    return F.when(x.isin("1", "true", "yes", "y"), True).when(x.isin("0", "false", "no", "n"), False)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, as double."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a: Column | str) -> Column:
    """L2-normalised array of doubles; NULL for a zero vector."""
    a = _c(a)
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda v: v.cast("double") / norm))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two arrays as sets; 0 if both are empty."""
    a, b = _c(a), _c(b)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def sql_sum(x: Column | str) -> Column:
    """Sum that is 0 for no value, as in a data frame library."""
    return F.coalesce(F.sum(_c(x)), F.lit(0.0))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Aggregate correlation over rows with both; NULL if either is constant or there is none."""
    x, y = _c(x).cast("double"), _c(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
