"""Tables in CSV, JSON lines and JSON documents, by declared schema; a missing file is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns as strings, by the files' headers; a column that no file has is NULL, and so is a blank."""
    schema = ", ".join(f"`{c}` string" for c in columns)

    def read() -> DataFrame:
        found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        return found.select([F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])

    return _or_empty(spark, schema, read)


def write_csv(df: DataFrame, path: str, columns: list[str], strict: bool = False) -> None:
    """Columns in the order given, blanks for NULL and for columns that ``df`` lacks; ``strict``: others in ``df`` are an error."""
    if strict and (extra := sorted(set(df.columns) - set(columns))):
        raise ValueError(f"columns that are not declared: {extra}")
    df.select([(F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, gzipped or not; blank lines are skipped, and a line that is no object fails."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def write_jsonl(df: DataFrame, path: str, compressed: bool = False) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip" if compressed else "none").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a document, with ``valid``: false (and NULL columns) where it can't be read as the schema says."""
    names = [f.name for f in StructType.fromDDL(schema)]
    whole = lambda: spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return _or_empty(spark, f"{schema}, _bad string", whole).select(*names, F.col("_bad").isNull().alias("valid"))
