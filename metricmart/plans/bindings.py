"""Canonical tables over the driver's star schema, and the same as SQL for the oracle.

obs: entity (part) x month history; mart: one row an entity with its latest state and rates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.operators.ranking import percentiles_tied
from metricmart.operators.robust import joined, medians, robust_z, with_mad
from metricmart.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly deltas of each entity, with running totals."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    month = li.groupBy(F.col("l_partkey").alias("entity_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("run")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("views_delta"), F.count("*").alias("likes_delta"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("comments_delta")
    )  # aggregated before the join
    rows = month.join(part.select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("group_id"), F.col("p_size").alias("size")), "entity_id")
    w = Window.partitionBy("entity_id").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in ("views", "likes", "comments"):
        rows = rows.withColumn(c, F.sum(f"{c}_delta").over(w))
    return rows


OBS = """
obs0 as (select l_partkey as entity_id, p_brand as group_id, p_size as size, cast(date_trunc('month', l_shipdate) as date) as run,
  cast(sum(cast(l_quantity as bigint)) as bigint) as views_delta, count(*) as likes_delta, count(case when l_returnflag = 'R' then 1 end) as comments_delta
  from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4),
obs as (select *, cast(sum(views_delta) over w as bigint) as views, cast(sum(likes_delta) over w as bigint) as likes, cast(sum(comments_delta) over w as bigint) as comments
  from obs0 window w as (partition by entity_id order by run rows between unbounded preceding and current row))"""


def mart(spark: SparkSession, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """``o``: the rows of ``obs``, where they are stored already."""
    o = obs(spark, sf_dir) if o is None else o
    last = o.groupBy("entity_id").agg(F.max_by(F.struct(*[c for c in o.columns if c != "entity_id"]), "run").alias("r"), F.min("run").alias("created"), F.count("*").alias("history")).select("entity_id", "r.*", "created", "history")
    execution = table(spark, sf_dir, "lineitem").agg(F.to_date(F.date_trunc("month", F.max("l_shipdate"))).alias("execution"))  # one row
    m = last.crossJoin(F.broadcast(execution)).withColumn("age_days", (F.col("size") - 1) * 4)  # as uploaded so many days before the execution
    ratio = lambda n, d: S.barrier(S.safe_divide(n, d))
    return (
        m.withColumn("eng", ratio(F.col("likes") + F.col("comments"), F.col("views")))
        .withColumn("like_rate", ratio(F.col("likes"), F.col("views")))
        .withColumn("comment_rate", ratio(F.col("comments"), F.col("views")))
        .withColumn("delta_eng", ratio(F.col("likes_delta") + F.col("comments_delta"), F.col("views_delta")))
        .withColumn("views_per_day", S.barrier(F.col("views") / F.greatest(F.col("age_days").cast("double"), F.lit(1 / 24))))
        .withColumn("bucket", S.duration_bucket(F.col("size") * 20))
    )


MART = (
    OBS
    + """,
last as (select * from (select *, min(run) over (partition by entity_id) as created, count(*) over (partition by entity_id) as history,
  row_number() over (partition by entity_id order by run desc) as rn from obs) where rn = 1),
execution as (select cast(date_trunc('month', max(l_shipdate)) as date) as execution from lineitem),
mart as (select l.*, execution, (size - 1) * 4 as age_days,
  round((likes + comments) / nullif(views, 0), 6) as eng, round(likes / nullif(views, 0), 6) as like_rate, round(comments / nullif(views, 0), 6) as comment_rate,
  round((likes_delta + comments_delta) / nullif(views_delta, 0), 6) as delta_eng,
  round(views / greatest(cast((size - 1) * 4 as double), 1.0e0 / 24), 6) as views_per_day,
  case when size * 20 <= 60 then 'short' when size * 20 <= 600 then 'mid' when size * 20 > 600 then 'long' else 'unknown' end as bucket
  from last l, execution)"""
)


#: What follows ``OBS`` in queries over histories.
HISTORY = """h as (select *, lag(run) over w as prev_run, lag(views_delta) over w as prev_delta from obs window w as (partition by entity_id order by run)),
v as (select *, round(views_delta / greatest(coalesce(date_diff('day', prev_run, run), 0), 1.0e0 / 24), 6) as velocity from h)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs with the row before, and velocity a day since then; a first row has the age 0, and an hour is the least."""
    w = Window.partitionBy("entity_id").orderBy("run")
    h = obs(spark, sf_dir).withColumn("prev_run", F.lag("run").over(w)).withColumn("prev_delta", F.lag("views_delta").over(w))
    days = F.coalesce(F.datediff("run", "prev_run"), F.lit(0)).cast("double")
    return h.withColumn("velocity", S.barrier(F.col("views_delta") / F.greatest(days, F.lit(1 / 24))))


def pct_sql(x: str) -> str:
    """Tie-averaged percentile as SQL over all rows of the query."""
    return f"round(case when {x} is null then null when (count({x}) over ()) <= 1 or (count(*) over (partition by {x})) = (count({x}) over ()) then 50.0e0 else ((rank() over (order by {x} nulls last)) - 1 + ((count(*) over (partition by {x})) - 1) / 2.0e0) / ((count({x}) over ()) - 1) * 100 end, 6)"


def scores(spark: SparkSession, sf_dir: str, o: DataFrame | None = None) -> DataFrame:
    """Growth, alpha, opportunity and anomaly scores of each entity."""
    m = mart(spark, sf_dir, o).withColumn("log_delta", F.log1p(F.greatest(F.col("views_delta"), F.lit(0)).cast("double")))
    m = stage(m)
    m = joined(m, medians(m, "views_delta", ["group_id"], "group_median"), ["group_id"]).withColumn("relative", S.barrier(F.col("views_delta") / F.greatest(S.zero(F.col("group_median")), F.lit(1.0))))
    m = stage(percentiles_tied(stage(m), {"views_delta": "growth_pct", "relative": "relative_pct", "eng": "eng_pct"}))
    m = with_mad(m, "log_delta", [])
    fresh, meta = S.barrier(100 * F.exp(-F.col("age_days") / 7)), F.when(F.col("size") % 2 == 0, 100.0).otherwise(0.0)
    m = m.withColumn("freshness", fresh).withColumn("metadata", meta)
    m = m.withColumn("alpha", F.when(F.col("growth_pct").isNotNull() & F.col("relative_pct").isNotNull() & F.col("eng_pct").isNotNull(), S.weighted_sum((0.35, F.col("growth_pct")), (0.20, F.col("relative_pct")), (0.20, F.col("eng_pct")), (0.15, F.col("freshness")), (0.10, F.col("metadata")))))
    m = m.withColumn("alpha", S.settled(S.clamp(F.col("alpha"))))
    m = m.withColumn("opportunity", S.settled(S.clamp(S.weighted_sum((0.50, F.col("alpha")), (0.25, F.col("relative_pct")), (0.15, F.col("eng_pct")), (0.10, F.col("freshness"))))))
    z = S.zero(robust_z(F.col("log_delta"), F.col("median"), F.col("mad")))
    return m.withColumn("anomaly", S.barrier(S.clamp(F.abs(z) / 5 * 100)))


SCORES = (
    MART
    + f""",
s0 as (select m.*, ln(1 + greatest(views_delta, 0)) as log_delta, median(views_delta) over (partition by group_id) as group_median from mart m),
s1 as (select *, round(views_delta / greatest(coalesce(group_median, 0), 1.0e0), 6) as relative from s0),
s2 as (select *, {pct_sql("views_delta")} as growth_pct, {pct_sql("relative")} as relative_pct, {pct_sql("eng")} as eng_pct,
  round(100 * exp(-age_days / 7.0e0), 6) as freshness, case when size % 2 = 0 then 100.0e0 else 0.0e0 end as metadata, (select median(log_delta) from s1) as med from s1),
s3 as (select *, (select median(abs(log_delta - med)) from s2) as mad,
  round(least(greatest(0.35 * growth_pct + 0.20 * relative_pct + 0.20 * eng_pct + 0.15 * freshness + 0.10 * metadata, 0), 100) + 1e-9, 6) as alpha from s2),
scores as (select *, round(least(greatest(0.50 * alpha + 0.25 * relative_pct + 0.15 * eng_pct + 0.10 * freshness, 0), 100) + 1e-9, 6) as opportunity,
  round(least(greatest(abs(coalesce(case when mad = 0 then 0 else 0.6745 * (log_delta - med) / mad end, 0)) / 5 * 100, 0), 100), 6) as anomaly from s3)"""
)
