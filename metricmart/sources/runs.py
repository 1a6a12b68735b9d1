"""Run partitions (dt=YYYY-MM-DD/run=HHMMSSZ or HHMMSS with an offset): write, parse, list, latest, latest before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.sources.files import read_jsonl

SNAPSHOT = "entity_id long, execution_date string, upload_date string, views long, likes long"


def run_labels(local: Column, offset: str = "+0000") -> tuple[Column, Column]:
    """dt and run of a local time with the given offset; UTC is written Z."""
    return F.date_format(local, "yyyy-MM-dd"), F.concat(F.date_format(local, "HHmmss"), F.lit("Z" if offset in ("+0000", "-0000", "Z") else offset))


def run_time(dt: Column, run: Column) -> Column:
    """The instant of a run, from either form; NULL where it is neither."""
    zone = F.when(F.substring(run, 7, 5) == "Z", F.lit("+0000")).otherwise(F.substring(run, 7, 5))
    whole = F.concat(dt, F.lit(" "), F.substring(run, 1, 6), zone)
    return F.when(run.rlike(r"^\d{6}(Z|[+-]\d{4})$"), F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HHmmssxx")))


def write_runs(df: DataFrame, path: str, local: Column, offset: str = "+0000") -> None:
    dt, run = run_labels(local, offset)
    df.withColumn("dt", dt).withColumn("run", run).repartition("dt", "run").write.mode("overwrite").partitionBy("dt", "run").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All rows with dt, run (strings) and run_key (instant); partitions of other names are left out."""
    table = spark.read.option("basePath", path).parquet(path).withColumn("dt", F.col("dt").cast("string")).withColumn("run", F.col("run").cast("string"))
    return table.withColumn("run_key", run_time(F.col("dt"), F.col("run"))).where("run_key is not null")


def list_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("dt", "run", "run_key").agg(F.count("*").alias("n"))


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the last run; none if there is none."""
    return runs.join(F.broadcast(runs.agg(F.max("run_key").alias("run_key"))), "run_key", "left_semi")  # one row


def latest_run_before(runs: DataFrame, instant: str) -> DataFrame:
    """Rows of the last run strictly before ``instant``."""
    return latest_run(runs.where(F.col("run_key") < F.lit(instant).cast("timestamp")))


def typed(rows: DataFrame, dates: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): ``dates`` from ISO text to instants; a row with one that can't be read is rejected with the columns' names."""
    parsed = {c: F.try_to_timestamp(F.col(c)) for c in dates}
    bad = F.array_compact(F.array(*[F.when(x.isNull(), F.lit(c)) for c, x in parsed.items()]))
    marked = rows.withColumn("reject", F.array_join(bad, "|"))
    return marked.where("reject = ''").drop("reject").withColumns(parsed), marked.where("reject <> ''")


#: Counts of deltas; text that is no whole number reads as NULL.
DELTA_COUNTS = ("views_delta", "likes_delta", "comments_delta", "previous_views", "current_views", "previous_likes", "current_likes", "previous_comments", "current_comments")
DELTA_FLAGS = ("is_new", "title_changed", "description_changed", "tags_changed")


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Deltas from JSON lines: the id, the instant, all counts and flags (unset ones are false). Rows whose date can't be
    read are left out; fields that a line lacks are NULL."""
    schema = ", ".join(["entity_id long", "execution_date string", *(f"{c} string" for c in DELTA_COUNTS), *(f"{c} boolean" for c in DELTA_FLAGS)])
    kept, _ = typed(read_jsonl(spark, path, schema), ["execution_date"])
    return kept.withColumns({c: F.trim(c).try_cast("bigint") for c in DELTA_COUNTS} | {c: F.coalesce(c, F.lit(False)) for c in DELTA_FLAGS})


def growth_export(snapshots: DataFrame, deltas: DataFrame, status: str = "success") -> DataFrame:
    """Each snapshot with its delta, if it has one, greatest first and unknown as -1; nothing after a run that was aborted."""
    if status not in ("success", "success_with_warnings"):
        snapshots = snapshots.limit(0)
    both = snapshots.join(deltas, "entity_id", "left").withColumn("is_new", F.col("previous").isNull())
    return both.orderBy(F.coalesce("views_delta", F.lit(-1)).desc(), "entity_id")
