"""Ranks and percentiles over a whole table without one task that sorts it.

Rows are dealt to value ranges (cuts from approximate quantiles); a window works within each range, and the counts of
the ranges before it, at most ``buckets`` + 1 rows, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh_name(taken: list[str], name: str) -> str:
    """``name``, or with underscores before it if it is taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def _cuts(df: DataFrame, values: list[str], buckets: int) -> dict[str, list[float]]:
    """Cuts of all columns from one job."""
    found = df.approxQuantile(values, [k / buckets for k in range(1, buckets)], 0.01) if buckets > 1 else [[]] * len(values)
    return {v: sorted(set(c)) for v, c in zip(values, found)}


def _range_of(df: DataFrame, value: str, buckets: int, cuts: list[float] | None = None) -> Column:
    cuts = _cuts(df, [value], buckets)[value] if cuts is None else cuts
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(value)))


def _before(counts: DataFrame) -> DataFrame:
    """range, before, total of a table range, n of at most ``buckets`` + 1 rows."""
    w = Window.orderBy("range")
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy())).select("range", "before", "total")


def ordinal_rank(df: DataFrame, value: str, tie: str, out: str = "rank", descending: bool = True, buckets: int = 64) -> DataFrame:
    """1, 2, ... by value and then ``tie``; NULLs are unranked. Also ``out``_n, the number of ranked rows."""
    known = df.where(F.col(value).isNotNull()).withColumn("range", _range_of(df, value, buckets))
    counts = known.groupBy("range").agg(F.count("*").alias("n"))
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()]
    signed = counts.withColumn("range", -F.col("range")) if descending else counts
    before = _before(signed)
    before = before.withColumn("range", -F.col("range")) if descending else before
    ranked = known.withColumn("in_range", F.row_number().over(Window.partitionBy("range").orderBy(*order))).join(F.broadcast(before), "range")
    ranked = ranked.select(*df.columns, (F.col("before") + F.col("in_range")).alias(out), F.col("total").alias(f"{out}_n"))
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("long")).withColumn(f"{out}_n", F.lit(None).cast("long")))


def _by_value(df: DataFrame, value: str, buckets: int, cuts: list[float] | None = None) -> DataFrame:
    """value, n, less (rows below it) and total of each distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value)).agg(F.count("*").alias("n")).withColumn("range", _range_of(df, value, buckets, cuts))
    before = _before(counts.groupBy("range").agg(F.sum("n").alias("n")))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(value)) - F.col("n")
    return counts.withColumn("inside", inside).join(F.broadcast(before), "range").select(value, "n", (F.col("before") + F.col("inside")).alias("less"), "total")


def percentiles_tied(df: DataFrame, outs: dict[str, str], buckets: int = 64) -> DataFrame:
    """For each column of ``outs`` its percentile from 0 to 100 with ties averaged; one value only: 50; NULL stays NULL.

    All come from ``df`` itself, so the plan grows with the number of columns and not with its power.
    """
    out, cuts = df, _cuts(df, list(outs), buckets)
    for value, name in outs.items():
        v = _by_value(df, value, buckets, cuts[value])
        pct = F.when((F.col("total") <= 1) | (F.col("n") == F.col("total")), 50.0).otherwise((F.col("less") + (F.col("n") + 1) / 2.0 - 1) / (F.col("total") - 1) * 100)
        v = v.select(F.col(value).alias(f"_{name}"), F.round(pct, 6).alias(name))
        out = out.join(v.hint("merge"), F.col(value) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return out


def percentile_tied(df: DataFrame, value: str, out: str, buckets: int = 64) -> DataFrame:
    return percentiles_tied(df, {value: out}, buckets)


def percentile_cume(df: DataFrame, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Share of rows at or below, times 100."""
    v = _by_value(df, value, buckets).select(F.col(value).alias("_v"), F.round((F.col("less") + F.col("n")) * 100.0 / F.col("total"), 6).alias(out))
    return df.join(v.hint("merge"), F.col(value) == F.col("_v"), "left").drop("_v")


def percentile_ordinal(df: DataFrame, value: str, tie: str, out: str, descending: bool = False, digits: int = 4) -> DataFrame:
    """By position; a single row is 50, or 100 if descending (the largest first, at 100)."""
    ranked = ordinal_rank(df, value, tie, "_r", descending)
    at = (F.col("_r") - 1) / (F.col("_r_n") - 1) * 100.0
    one = 100.0 if descending else 50.0
    return ranked.withColumn(out, F.when(F.col("_r_n") == 1, one).when(F.col("_r").isNotNull(), F.round(100 - at if descending else at, digits))).drop("_r", "_r_n")


def running_sums(df: DataFrame, value: str, tie: str, columns: list[str], descending: bool = True, buckets: int = 64) -> DataFrame:
    """Adds rank and, for each column, its sum over all rows up to this one in the order of value and then ``tie``."""
    known = df.where(F.col(value).isNotNull()).withColumn("range", _range_of(df, value, buckets) * (-1 if descending else 1))
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie).asc()]
    w = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = known.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"t_{c}") for c in columns])  # at most buckets + 1 rows
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("b_n"), *[F.coalesce(F.sum(f"t_{c}").over(earlier), F.lit(0)).alias(f"b_{c}") for c in columns])
    inside = known.withColumn("i_n", F.count("*").over(w))
    for c in columns:
        inside = inside.withColumn(f"i_{c}", F.sum(c).over(w))
    return inside.join(F.broadcast(before), "range").select(*df.columns, (F.col("b_n") + F.col("i_n")).alias("rank"), *[(F.col(f"b_{c}") + F.col(f"i_{c}")).alias(f"sum_{c}") for c in columns])
