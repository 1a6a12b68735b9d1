"""Streams of tables: what has come is read in micro-batches, state and results lie in the shared folder.

Results don't depend on how rows fall into micro-batches, as long as rows come no later than the watermark's delay
(windows) or keys come in order of time (differences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricmart.operators.dedupe import keep_latest, upsert
from metricmart.session import folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of files; files added to a folder are further micro-batches."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # as a pattern, since a path alone would have to be a folder


def appended(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that has come and returns the rows it has appended; windows still open are held back."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    stream.writeStream.format("parquet").outputMode("append").option("path", at).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def _each_batch(stream: DataFrame, batch) -> None:
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", folder(stream.sparkSession)).trigger(availableNow=True).start().awaitTermination()


def _state(spark: SparkSession, at: str, version: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{at}/{version}") if version >= 0 else spark.createDataFrame([], schema)


def latest_rows(stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key. Each micro-batch writes a new version of the table, so one that is run again after
    a failure gives the same version."""
    at, seen = folder(stream.sparkSession), []

    def merge(rows: DataFrame, version: int) -> None:
        old = _state(rows.sparkSession, at, version - 1, rows.schema)
        upsert(old, rows, key, order).select(rows.columns).write.mode("overwrite").parquet(f"{at}/{version}")
        seen.append(version)

    _each_batch(stream, merge)
    return _state(stream.sparkSession, at, max(seen, default=-1), stream.schema)


def keyed_differences(stream: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with its value less the one before it of the same key; NULL for a key's first row. A micro-batch is
    compared with the last rows of those before it; its size (maxFilesPerTrigger) bounds what a key sorts."""
    at, out, seen = folder(stream.sparkSession), folder(stream.sparkSession), []

    def step(rows: DataFrame, version: int) -> None:
        old = _state(rows.sparkSession, at, version - 1, rows.schema)
        both = old.withColumn("_old", F.lit(True)).unionByName(rows.withColumn("_old", F.lit(False)))
        # the earlier row goes first, whatever its time
        by_state = Window.partitionBy(*key).orderBy(F.col("_old").desc(), *order)
        both.withColumn("delta", F.col(value) - F.lag(value).over(by_state)).where("not _old").drop("_old").write.mode("overwrite").parquet(f"{out}/batch={version}")
        keep_latest(both.drop("_old"), key, order).select(rows.columns).write.mode("overwrite").parquet(f"{at}/{version}")
        seen.append(version)

    _each_batch(stream, step)
    if not seen:
        return stream.sparkSession.createDataFrame([], stream.schema).withColumn("delta", F.col(value) - F.col(value))
    return stream.sparkSession.read.parquet(out).drop("batch")
