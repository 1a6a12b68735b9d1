"""Dense numbers in the order of a sort, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.operators.ranking import fresh_name
from metricmart.session import stage


def numbered(df: DataFrame, order: list[Column | str], out: str = "index", start: int = 0) -> DataFrame:
    """Adds ``start``, ``start`` + 1, ... in the given order (equal rows in any).

    Rows are dealt to ranges of the order and numbered within each; only the ranges' sizes, one row a partition, are
    added up over all.
    """
    part, at, before = (fresh_name([*df.columns, out], x) for x in ("part", "at", "before"))
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(dealt.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(at, F.col(at) - F.shiftleft(F.col(part).cast("long"), 33))  # the row's place in its range
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sizes = sizes.select(F.col(part), F.coalesce(F.sum("n").over(w), F.lit(0)).alias(before))
    return placed.join(F.broadcast(sizes), part).select(*df.columns, (F.col(before) + F.col(at) + start).alias(out))
