"""Scalar columns: scores, labels, distances, calendar codes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null: ``greatest`` and ``least`` would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def rounded(c: Column, digits: int) -> Column:
    """Like ``round`` of the SQL: the whole number nearest to ``c`` times a power of ten (halves go away from zero), with the sign of ``c`` even at zero.

    Spark's ``round`` looks at the decimal text of ``c`` instead, so the two differ at ties.
    """
    r = F.round(c * 10.0**digits) / 10.0**digits
    return F.when((r == 0) & (c < 0), F.lit(-0.0)).otherwise(r)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def softplus(c: Column) -> Column:
    return F.log1p(F.exp(c))


def quantile_score(v: Column, q50: Column, q90: Column) -> Column:
    return F.coalesce(clamp(F.try_divide(v - q50, q90 - q50), 0.0, 1.25), F.lit(0.0))


def inverse_quantile_score(v: Column, q10: Column, q50: Column) -> Column:
    return F.coalesce(clamp(F.try_divide(q50 - v, q50 - q10), 0.0, 1.25), F.lit(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(1e-12))))


def month_part(date: Column) -> Column:
    """early, middle or late third of the month."""
    return F.when(F.dayofmonth(date) <= 10, "early").when(F.dayofmonth(date) <= 20, "middle").otherwise("late")


def cyclic_day(date: Column, days: float = 365.25) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.dayofyear(date) / F.lit(days)
    return F.sin(angle), F.cos(angle)


def tertile(v: Column, low: Column, high: Column) -> Column:
    return F.when(v <= low, "low").when(v <= high, "mid").otherwise("high")


def sentinel_float(c: Column) -> Column:
    """A number, or null for blanks and the marks of a missing reading."""
    return F.when(~F.trim(c).isin("", "-", "-1", "-2"), c.try_cast("double"))


def grade(missing: Column, invalid: Column, duplicate: Column) -> Column:
    """A to D by the worst of three rates."""
    return F.when((missing <= 0.05) & (invalid <= 0.01) & (duplicate <= 0.01), "A").when((missing <= 0.15) & (invalid <= 0.05) & (duplicate <= 0.05), "B").when((missing <= 0.35) & (invalid <= 0.15), "C").otherwise("D")
