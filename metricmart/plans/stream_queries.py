"""Streams over ``events`` and ``documents``: windows, sessions, expiry, first captures, latest rows, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.plans.bindings import table
from metricmart.plans.registry import register
from metricmart.streaming import state, tables

_MARK = "(select date_trunc('milliseconds', max(ts)) - interval 1 hour from events)"


def _events(spark, sf) -> DataFrame:
    return tables.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _marked(spark, sf) -> DataFrame:
    return _events(spark, sf).withWatermark("ts", "1 hour")


@register(f"select * from (select cast(date_trunc('hour', ts) as timestamp) as window_start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2) where window_start + interval 1 hour <= {_MARK}")
def stream_tumbling_counts(spark, sf):
    grouped = _marked(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return tables.appended(grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total"))


def _sessions_sql(hours: int) -> str:
    return f"""with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < {hours * 3_600_000_000} then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sid from g),
 e as (select user_id, min(ts) as started, max(ts) as last_seen, count(*) as n from s group by user_id, sid having max(ts) + interval {hours} hours <= {_MARK})"""


def _sessions(spark, sf, hours: int) -> DataFrame:
    grouped = _marked(spark, sf).groupBy(F.session_window("ts", f"{hours} hours").alias("w"), "user_id")
    return tables.appended(grouped.agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("n")).select("user_id", "started", "last_seen", "n"))


@register(f"{_sessions_sql(6)} select user_id, started, n from e")
def stream_sessions(spark, sf):
    return _sessions(spark, sf, 6).select("user_id", "started", "n")


@register(f"{_sessions_sql(48)} select user_id, last_seen, last_seen + interval 48 hours as expired_at from e")
def stream_expiry(spark, sf):
    """Users unseen for two days, each time they expire."""
    return _sessions(spark, sf, 48).select("user_id", "last_seen", (F.col("last_seen") + F.expr("interval 48 hours")).alias("expired_at"))


@register(f"select * from (select user_id, cast(date_trunc('day', ts) as date) as day, arg_min(event_id, (ts, event_id)) as event_id from events group by 1, 2) where cast(day as timestamp) + interval 1 day <= {_MARK}")
def stream_first_capture(spark, sf):
    first = _marked(spark, sf).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return tables.appended(first.select("user_id", F.to_date("w.start").alias("day"), F.col("f.event_id").alias("event_id")))


@register("select user_id, arg_max(event_id, (ts, event_id)) as event_id, max(ts) as ts from events group by 1")
def stream_keep_latest(spark, sf):
    return tables.latest_rows(_events(spark, sf).select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])


@register("select user_id, event_id, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events")
def stream_keyed_delta(spark, sf):
    rows = tables.keyed_differences(_events(spark, sf).select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
    return rows.select("user_id", "event_id", "delta")


@register("select distinct sha256(text) as text_sha from documents")
def stream_content_skip(spark, sf):
    """Contents met for the first time; the state holds one digest for each."""
    return tables.appended(tables.read_table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_sha")).dropDuplicates(["text_sha"]))


def _in_runs(spark, sf, make, twice: bool = False) -> DataFrame:
    """A keyed stream over the events in three runs from one checkpoint, each reading the files that came since the last."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    run = None
    for stream in state.in_slices(e.unionByName(e) if twice else e, "ts", 3):
        rows, schema = make(stream)
        run = (run or state.Run.new(spark, schema)).go(rows)
    return run.rows()


@register("select user_id, event_id, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events")
def stream_state_delta(spark, sf):
    """Differences from state by key."""
    return _in_runs(spark, sf, lambda s: state.differences(s, "user_id", "ts", "event_id", "value"))


@register(f"{_sessions_sql(48)} select user_id, last_seen, last_seen + interval 48 hours as expired_at, n from e")
def stream_timer_expiry(spark, sf):
    """Users unseen for two days, by event timers."""
    return _in_runs(spark, sf, lambda s: state.expired(s, "user_id", "ts", "1 hour", 48))


@register("select event_id, user_id, ts from events")
def stream_exactly_once(spark, sf):
    """Events that are each delivered twice, kept once with state for an hour only."""
    return _in_runs(spark, sf, lambda s: (state.first_within(s.select("event_id", "user_id", "ts"), ["event_id"], "ts", "1 hour"), "event_id long, user_id long, ts timestamp"), twice=True)
