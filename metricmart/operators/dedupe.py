"""Keep-latest, upserts and catalog upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the greatest by ``order``; a pre-aggregated maximum, no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows beside old ones, the latest of each key; of equal ones the new."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_latest(both, key, [*order, "_new"]).drop("_new")


def append_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(old.columns))


def mode_first_seen(df: DataFrame, by: list[str], value: str, first: str, out: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the one met first in the order of ``first``.

    Counts come first, so a group's rows meet in no task, only its distinct values do, pre-aggregated. NULL values
    count as values; a group column's NULL is a group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(first).alias("_f"))
    best = F.min_by(F.struct(F.col(value), F.col("_n")), F.struct((-F.col("_n")).alias("n"), F.isnull("_f").alias("late"), F.col("_f")))
    return counts.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{value}").alias(out), F.col("_b._n").alias(f"{out}_count"))
