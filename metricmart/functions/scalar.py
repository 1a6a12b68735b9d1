"""Numeric rules: safe division, clamping, thresholds, weighted scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def barrier(x: Column) -> Column:
    """Six decimals, as values are between steps."""
    return F.round(x, 6)


def settled(x: Column) -> Column:
    """Six decimals of a weighted score: half a unit goes up whatever the order in which its parts were added."""
    return F.round(x + 1e-9, 6)


def safe_divide(n: Column, d: Column) -> Column:
    """NULL where the denominator is NULL or 0."""
    return F.try_divide(n.cast("double"), d.cast("double"))


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def log1p_safe(x: Column) -> Column:
    """NULL at -1 and below."""
    return F.when(x > -1, F.log1p(x))


def safe_int(x: Column) -> Column:
    return F.trim(x).try_cast("bigint")


def safe_float(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def to_bool(x: Column, *true: str) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(*(true or ("1", "true", "yes", "y"))), F.lit(False))


def by_threshold(x: Column, steps: list[tuple[float, str]], otherwise: str, below: bool = False) -> Column:
    """The first label whose bound x reaches (with ``below``: stays under); NULL stays NULL."""
    out = F.lit(otherwise)
    for bound, label in reversed(steps):
        out = F.when(x < bound if below else x >= bound, F.lit(label)).otherwise(out)
    return F.when(x.isNotNull(), out)


def duration_bucket(x: Column) -> Column:
    return F.coalesce(F.when(x <= 60, "short").when(x <= 600, "mid").when(x > 600, "long"), F.lit("unknown"))


def lifecycle_stage(age_days: Column) -> Column:
    return F.coalesce(by_threshold(age_days, [(1, "launch"), (7, "early"), (30, "growth"), (90, "mature")], "archive", below=True), F.lit("unknown"))


def trend_label(ratio: Column) -> Column:
    return F.coalesce(by_threshold(ratio, [(2, "accelerating"), (0.8, "stable"), (0.2, "decelerating")], "fading"), F.lit("unknown"))


def horizon_label(age_days: Column) -> Column:
    return F.coalesce(F.when(age_days <= 3, "short").when(age_days <= 30, "mid").when(age_days <= 180, "long").when(age_days > 180, "archive"), F.lit("unknown"))


def severity(score: Column) -> Column:
    return by_threshold(score, [(90, "critical"), (75, "high"), (55, "medium")], "low")


def confidence_level(score: Column) -> Column:
    return by_threshold(score, [(70, "high"), (40, "medium")], "low")


def weighted_sum(*parts: tuple[float, Column]) -> Column:
    """NULL inputs count 0."""
    return reduce(lambda a, b: a + b, [w * zero(x) for w, x in parts])


def weighted_renormalised(*parts: tuple[float, Column]) -> Column:
    """Weighted mean over the inputs that are not NULL; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts])
    return F.try_divide(weighted_sum(*parts), total)


def adjusted(raw: Column, confidence: Column) -> Column:
    return raw * (0.5 + 0.5 * confidence / 100)
