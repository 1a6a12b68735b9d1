"""Typed publishing of text tables: the types of all columns from one pass over all rows, then typed files and a manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("bool", "int", "float", "string")
SPARK_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string"}


def kind(x: Column) -> Column:
    """bool (True, False), int, float (digits around one point), string; NULL for empty text. Blanks around don't count."""
    t = F.trim(x)
    return F.when(x.isNull() | (t == ""), None).when(t.isin("True", "False"), "bool").when(t.rlike(r"^[+-]?[0-9]+$"), "int").when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), "float").otherwise("string")


def inferred(df: DataFrame) -> DataFrame:
    """name, position (from 1), type, row_count and nulls of each column of a table of texts. One aggregate over the table.

    A column is bool, int or float if all its values are (whole numbers among floats count as such; a whole number
    beyond 64 bits makes a float), else a string; without a value a string."""
    one = lambda c, k: F.sum(F.when(kind(F.col(f"`{c}`")) == k, 1).otherwise(0))
    wide = lambda c: F.sum(F.when((kind(F.col(f"`{c}`")) == "int") & F.trim(F.col(f"`{c}`")).try_cast("bigint").isNull(), 1).otherwise(0))
    facts = [F.struct(F.lit(c).alias("name"), F.lit(i).alias("position"), *[F.coalesce(one(c, k), F.lit(0)).alias(k) for k in KINDS], F.coalesce(wide(c), F.lit(0)).alias("wide"), F.count("*").alias("row_count")) for i, c in enumerate(df.columns, 1)]
    each = df.agg(F.array(*facts).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")
    known = reduce(lambda a, b: a + b, [F.col(k) for k in KINDS])
    type_ = F.when(known == 0, "string").when(F.col("bool") == known, "bool").when((F.col("int") == known) & (F.col("wide") == 0), "int").when(F.col("int") + F.col("float") == known, "float").otherwise("string")
    return each.select("name", "position", type_.alias("type"), "row_count", (F.col("row_count") - known).alias("nulls"))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns cast by ``types``; empty text is NULL, and strings stay as they are."""

    def cast(c: str) -> Column:
        x, t = F.col(f"`{c}`"), F.trim(F.col(f"`{c}`"))
        return F.when(t == "", None).otherwise(x if types[c] == "string" else (t == "True") if types[c] == "bool" else t.cast(SPARK_TYPES[types[c]])).alias(c)

    return df.select(*[cast(c) for c in df.columns])


def publish(spark: SparkSession, csv: dict[str, str], path: str) -> DataFrame:
    """Writes each CSV (name: path) as typed JSON lines under ``path``/<name> and the manifest under ``path``/manifest,
    and returns it: name, row_count, columns and types in order, status. A table that can't be read has the status
    ``missing`` and no files. The manifest is written last, so it names nothing that isn't there."""
    made = []
    for name, source in csv.items():
        if not spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(source)):
            made.append((name, 0, [], [], "missing"))
            continue
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(source)
        facts = sorted(inferred(df).collect(), key=lambda r: r.position)  # one row a column
        types = {r["name"]: r["type"] for r in facts}
        typed(df, types).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")
        made.append((name, facts[0].row_count if facts else 0, list(types), list(types.values()), "published"))
    manifest = spark.createDataFrame(made, "name string, row_count long, columns array<string>, types array<string>, status string").coalesce(1)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
