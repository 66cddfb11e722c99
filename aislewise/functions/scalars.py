"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

EARTH_RADIUS_KM = 6371.0


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c, digits: int = 0) -> Column:
    """Round half up in plain double arithmetic (same bits on every engine)."""
    scale = float(10 ** digits)
    return F.floor(as_col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clip(c, low=None, high=None) -> Column:
    """Clamp to [low, high]; a null stays null (``greatest`` alone would fill it)."""
    c = as_col(c)
    out = c
    if low is not None:
        low = low if isinstance(low, Column) else F.lit(low)
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        high = high if isinstance(high, Column) else F.lit(high)
        out = F.when(out > high, high).otherwise(out)
    return F.when(c.isNotNull(), out)


def money_sum(c) -> Column:
    """Sum of amounts in whole cents: exact, so task order and retries cannot move it."""
    return F.sum(F.floor(as_col(c) * 100.0 + 0.5)) / F.lit(100.0)


def money_mean(c) -> Column:
    return money_sum(c) / F.count(as_col(c))


def rate_mean(c) -> Column:
    """Mean of shares in whole millionths: exact like ``money_mean``, but 12.5 % stays 12.5 %."""
    return F.sum(F.floor(as_col(c) * 1e6 + 0.5)) / F.lit(1e6) / F.count(as_col(c))


def ratio(numerator, denominator, otherwise=None) -> Column:
    """Division that yields ``otherwise`` (default null) when the divisor is 0 or null."""
    numerator, denominator = as_col(numerator), as_col(denominator)
    guarded = F.try_divide(numerator, denominator)
    return guarded if otherwise is None else F.coalesce(guarded, F.lit(otherwise))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def quantile_bin(c, edges: list[Column]) -> Column:
    """1 + number of inner edges strictly below the value: right-closed quantile bins."""
    c = as_col(c)
    return reduce(lambda acc, e: acc + F.when(c > e, 1).otherwise(0), edges, F.lit(1))


def cut(c, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed intervals; a value at or under the first bound has no label."""
    c = as_col(c)
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(bounds, bounds[1:], labels))):
        out = F.when((c > low) & (c <= high), F.lit(label)).otherwise(out)
    return out


def contains_any(text, words: list[str]) -> Column:
    text = as_col(text)
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_match(text, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Label of the first rule one of whose words occurs in the text."""
    out = F.lit(otherwise)
    for label, words in reversed(rules):
        out = F.when(contains_any(text, words), F.lit(label)).otherwise(out)
    return out


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(as_col, (lat1, lon1, lat2, lon2))
    half_dphi = F.radians(lat2 - lat1) / 2
    half_dlam = F.radians(lon2 - lon1) / 2
    a = (F.sin(half_dphi) * F.sin(half_dphi)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.sin(half_dlam) * F.sin(half_dlam))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


# Coefficients of P. Acklam's rational approximation of the inverse
# normal distribution (relative error below 1.2e-9).
_CENTRE_NUM = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
               1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_CENTRE_DEN = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
               6.680131188771972e+01, -1.328068155288572e+01, 1.0)
_TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
             -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
             3.754408661907416e+00, 1.0)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))


def normal_quantile(p) -> Column:
    """Inverse of the standard normal distribution for 0.02425 <= p < 1."""
    p = as_col(p)
    q = p - 0.5
    centre = q * _polynomial(_CENTRE_NUM, q * q) / _polynomial(_CENTRE_DEN, q * q)
    t = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    upper = -_polynomial(_TAIL_NUM, t) / _polynomial(_TAIL_DEN, t)
    return F.when(p <= 1 - 0.02425, centre).otherwise(upper)


def one_row(df: DataFrame, *columns: str) -> Column:
    """A one-row frame as a scalar subquery: a struct when it has several columns."""
    names = list(columns) or df.columns
    if len(names) == 1:
        return df.select(names[0]).scalar()
    return df.select(F.struct(*names).alias("row")).scalar()


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with a null grouping key, as a pandas group-by does."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into exactly ``spark.sql.shuffle.partitions`` parts.

    For small rows that are about to multiply in a join: sized by its input bytes,
    such a stage would be coalesced into far too few tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are computed once, however often later steps read them.

    A one-element ``inline`` is a step the optimizer does not merge into its readers.
    """
    return df.select("*", F.inline(F.array(F.struct(
        *[c.alias(name) for name, c in columns.items()]))))
