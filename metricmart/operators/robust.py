"""Robust statistics: exact medians, MAD, floor-index quartiles, rank quantiles.

Values are counted first (group, value, count). The counts are cut into bands of values; only the bands that hold a
wanted position are ordered, each on its own. So no task meets all values of a group, nor of the table.
``iqr_floor`` and the other aggregates collect a group and are for groups of a known small size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.operators.ranking import fresh_name


def _at(values: Column, index: Column) -> Column:
    return F.element_at(values, (index + 1).cast("int"))


def iqr_floor(x: str) -> Column:
    """Aggregate: sorted[floor(.75(n-1))] - sorted[floor(.25(n-1))]; under two values NULL."""
    a = F.sort_array(F.collect_list(x))
    n = F.count(x)
    return F.when(n >= 2, _at(a, F.floor(0.75 * (n - 1))) - _at(a, F.floor(0.25 * (n - 1))))


#: Positions (from 0) of order statistics among n sorted values.
LOWER_MIDDLE: Callable[[Column], Column] = lambda n: F.floor((n - 1) / 2)
UPPER_MIDDLE: Callable[[Column], Column] = lambda n: F.floor(n / 2)


def floor_quantile(q: float) -> Callable[[Column], Column]:
    """sorted[floor(q (n - 1))]."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def disc_quantile(q: float) -> Callable[[Column], Column]:
    """sorted[ceil(q n) - 1]."""
    return lambda n: F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))


def band(x: Column) -> Column:
    """A whole number that never falls as x grows: 64 bands for each doubling, known without a pass over the data."""
    size = F.abs(x.cast("double"))
    level = F.floor(F.greatest(F.least(F.log2(size), F.lit(1100.0)), F.lit(-1100.0)) * 64) + 80000
    return F.when(F.isnan(size), 200000).when(size == 0, 0).otherwise(F.when(x < 0, -level).otherwise(level)).cast("long")


def order_statistics(df: DataFrame, x: str, by: list[str], picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group (no group column: one row) the values of ``x`` at the positions ``picks`` give for n known values.

    NULLs of ``x`` don't count; a group without a known value has no row; a NULL group is a group.
    """
    v, n, b = (fresh_name([*by, *picks], name) for name in ("value", "n", "band"))
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias(v)).agg(F.count("*").alias(n)).withColumn(b, band(F.col(v)))
    keys = [f"k{i}" for i in range(len(by))]
    bands = counts.groupBy(*by, b).agg(F.sum(n).alias("held")).toDF(*keys, "kb", "held")
    w = Window.partitionBy(*keys)  # bands only: some thousands a group at most
    bands = bands.withColumn("before", F.coalesce(F.sum("held").over(w.orderBy("kb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("held").over(w))
    bands = bands.select("*", *[pick(F.col("all")).cast("long").alias(f"at{i}") for i, pick in enumerate(picks.values())])
    inside = [(F.col(f"at{i}") >= F.col("before")) & (F.col(f"at{i}") < F.col("before") + F.col("held")) for i in range(len(picks))]
    wanted = bands.where(F.array_contains(F.array(*inside), True))
    same = F.col(b) == F.col("kb")
    for k, g in zip(keys, by):
        same = same & F.col(g).eqNullSafe(F.col(k))
    rows = counts.join(wanted, same)
    rows = rows.withColumn("upto", F.col("before") + F.sum(n).over(Window.partitionBy(*by, b).orderBy(v)))
    hit = lambda i: (F.col(f"at{i}") < F.col("upto")) & (F.col(f"at{i}") >= F.col("upto") - F.col(n))
    return rows.groupBy(*by).agg(*[F.max(F.when(hit(i), F.col(v))).alias(name) for i, name in enumerate(picks)])


def medians(df: DataFrame, x: str, by: list[str], out: str = "median") -> DataFrame:
    """The groups' exact medians (double), by the rules of ``order_statistics``."""
    both = order_statistics(df, x, by, {"lower_middle": LOWER_MIDDLE, "upper_middle": UPPER_MIDDLE})
    return both.select(*by, (F.col("lower_middle").cast("double") * 0.5 + F.col("upper_middle").cast("double") * 0.5).alias(out))


def joined(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's statistics (NULL where it has none); without group columns ``stats`` is one row."""
    if not by:
        return df.crossJoin(F.broadcast(stats))
    renamed = stats.toDF(*[f"_s{i}" for i in range(len(by))], *stats.columns[len(by) :])
    same = F.lit(True)
    for i, g in enumerate(by):
        same = same & F.col(g).eqNullSafe(F.col(f"_s{i}"))
    return df.join(renamed, same, "left").drop(*[f"_s{i}" for i in range(len(by))])


def with_mad(df: DataFrame, x: str, by: list[str], median: str = "median", mad: str = "mad") -> DataFrame:
    """Adds the median and the median absolute deviation within groups; no group column: of the whole table (one row, broadcast)."""
    with_m = joined(df, medians(df, x, by, median), by)
    off = fresh_name(with_m.columns, "off")
    apart = with_m.select(*by, F.abs(F.col(x) - F.col(median)).alias(off))
    return joined(with_m, medians(apart, off, by, mad), by)


def robust_z(x: Column, median: Column, mad: Column) -> Column:
    return F.when(mad == 0, 0.0).otherwise(F.try_divide(0.6745 * (x - median), mad))
