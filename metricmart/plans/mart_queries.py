"""Mart queries: metrics, ranks, robust statistics, periods, histories; each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.operators import ranking, robust
from metricmart.operators.dedupe import append_absent, keep_latest, upsert
from metricmart.operators.joins import asof_backward, asof_nearest, merge_right_biased
from metricmart.plans.bindings import HISTORY, MART, OBS, SCORES, history, mart, obs, pct_sql, scores, table
from metricmart.plans.registry import register
from metricmart.session import stage

METRIC_COLUMNS = ["entity_id", "group_id", "bucket", "run", "created", "age_days", "views", "likes", "comments", "views_delta", "eng", "like_rate", "comment_rate", "delta_eng", "views_per_day"]


def d(x: Column) -> Column:
    return x.cast("double")


@register(f"with {MART} select {', '.join(METRIC_COLUMNS)} from mart")
def entity_metrics(spark, sf):
    return mart(spark, sf).select(METRIC_COLUMNS)


@register(f"with {MART} select entity_id, round(ln(1 + views), 6) as log_views, round(views_delta / greatest(age_days, 1.0e0), 6) as delta_per_day, round(0.5 * views_delta * (0.5 + 0.5 * least(history / 10.0e0, 1)), 6) as adjusted_delta from mart")
def entity_rates(spark, sf):
    m = mart(spark, sf)
    return m.select("entity_id", S.barrier(S.log1p_safe(d(F.col("views")))).alias("log_views"), S.barrier(F.col("views_delta") / F.greatest(d(F.col("age_days")), F.lit(1.0))).alias("delta_per_day"), S.barrier(S.adjusted(0.5 * F.col("views_delta"), 100 * F.least(F.col("history") / 10.0, F.lit(1.0)))).alias("adjusted_delta"))


@register(f"with {MART} select entity_id, age_days, case when age_days < 1 then 'launch' when age_days < 7 then 'early' when age_days < 30 then 'growth' when age_days < 90 then 'mature' else 'archive' end as stage from mart")
def lifecycle_stage(spark, sf):
    return mart(spark, sf).select("entity_id", "age_days", S.lifecycle_stage(F.col("age_days")).alias("stage"))


@register(f"""with {MART} select entity_id, case when age_days <= 3 then 'short' when age_days <= 30 then 'mid' when age_days <= 180 then 'long' else 'archive' end as horizon,
 age_days <= 3 as is_short, age_days between 4 and 30 as is_mid, age_days between 31 and 180 as is_long, age_days >= 30 as is_evergreen, age_days <= 7 as is_burst,
 case when age_days is null then 'missing_age' when history < 3 then 'low_history' else 'ok' end as reason from mart""")
def horizon_eligibility(spark, sf):
    age, m = F.col("age_days"), mart(spark, sf)
    return m.select("entity_id", S.horizon_label(age).alias("horizon"), (age <= 3).alias("is_short"), age.between(4, 30).alias("is_mid"), age.between(31, 180).alias("is_long"), (age >= 30).alias("is_evergreen"), (age <= 7).alias("is_burst"), F.when(age.isNull(), "missing_age").when(F.col("history") < 3, "low_history").otherwise("ok").alias("reason"))


@register(f"with {MART} select entity_id, views_delta, row_number() over (order by views_delta desc, entity_id) as rank from mart qualify rank <= 50")
def growth_rank_topk(spark, sf):
    top = mart(spark, sf).select("entity_id", "views_delta").orderBy(F.desc("views_delta"), "entity_id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("views_delta"), "entity_id")))  # 50 rows


@register(f"with {MART} select entity_id, row_number() over (order by views_delta desc, entity_id) as rank, count(*) over () as rank_n from mart")
def growth_rank_all(spark, sf):
    return ranking.ordinal_rank(mart(spark, sf).select("entity_id", "views_delta"), "views_delta", "entity_id").select("entity_id", "rank", "rank_n")


@register(f"""with {MART} select group_id, count(*) as n, count(*) filter (where bucket = 'mid') as n_mid, cast(sum(views) as bigint) as views, cast(sum(views_delta) as bigint) as views_delta,
 round(avg(eng), 4) as avg_eng, median(views_delta) as median_delta, arg_max(entity_id, views_delta * 1000000 - entity_id) as top_entity, count(*) filter (where views_delta >= 100) as n_big from mart group by 1""")
def group_metrics(spark, sf):
    m = stage(mart(spark, sf).select("entity_id", "group_id", "bucket", "views", "views_delta", "eng"))
    g = m.groupBy("group_id").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "mid").alias("n_mid"), F.sum("views").alias("views"), F.sum("views_delta").alias("views_delta"), F.round(F.avg("eng"), 4).alias("avg_eng"), F.max_by("entity_id", F.struct("views_delta", -F.col("entity_id"))).alias("top_entity"), F.count_if(F.col("views_delta") >= 100).alias("n_big"))
    return robust.joined(g, robust.medians(m, "views_delta", ["group_id"], "median_delta"), ["group_id"])


@register(f"with {MART} select group_id, median(views_delta) as median_delta, round(avg(views_delta), 6) as avg_delta, median(eng) as median_eng, median(views_per_day) as median_vpd, round(median(views_delta) / nullif(avg(views_delta), 0), 6) as ratio from mart group by 1")
def group_baselines(spark, sf):
    m = stage(mart(spark, sf).select("group_id", "views_delta", "eng", "views_per_day"))
    g = m.groupBy("group_id").agg(F.avg("views_delta").alias("avg"))
    for x, out in (("views_delta", "median_delta"), ("eng", "median_eng"), ("views_per_day", "median_vpd")):
        g = robust.joined(g, robust.medians(m, x, ["group_id"], out), ["group_id"])
    return g.select("group_id", "median_delta", S.barrier(F.col("avg")).alias("avg_delta"), "median_eng", "median_vpd", S.barrier(S.safe_divide(F.col("median_delta"), F.col("avg"))).alias("ratio"))


@register(f"with {MART} select bucket, median(views_delta) as median_delta, count(*) as n from mart group by 1")
def bucket_median(spark, sf):
    m = stage(mart(spark, sf).select("bucket", "views_delta"))  # a bucket may hold a third of all rows
    return robust.joined(m.groupBy("bucket").agg(F.count("*").alias("n")), robust.medians(m, "views_delta", ["bucket"], "median_delta"), ["bucket"]).select("bucket", "median_delta", "n")


@register(f"with {MART} select count(*) as entities, count(distinct group_id) as groups, cast(sum(views) as bigint) as views, cast(sum(views_delta) as bigint) as views_delta, max(run) as last_run from mart")
def run_totals(spark, sf):
    return mart(spark, sf).agg(F.count("*").alias("entities"), F.countDistinct("group_id").alias("groups"), F.sum("views").alias("views"), F.sum("views_delta").alias("views_delta"), F.max("run").alias("last_run"))


@register(f"with {SCORES} select round(sum(coalesce(alpha, 0)) / count(*), 4) as avg_alpha, round(sum(coalesce(opportunity, 0)), 3) as sum_opportunity, count(*) filter (where alpha < 50) as low from scores")
def kpi_cards(spark, sf):
    return scores(spark, sf).agg(F.round(F.sum(S.zero(F.col("alpha"))) / F.count("*"), 4).alias("avg_alpha"), F.round(F.sum(S.zero(F.col("opportunity"))), 3).alias("sum_opportunity"), F.count_if(F.col("alpha") < 50).alias("low"))


@register(f"with {MART} select entity_id, {pct_sql('views_delta')} as pct from mart")
def percentile_tied(spark, sf):
    return ranking.percentile_tied(mart(spark, sf).select("entity_id", "views_delta"), "views_delta", "pct").select("entity_id", "pct")


@register(f"with {MART} select entity_id, round(cume_dist() over (order by views_delta) * 100, 6) as pct from mart")
def percentile_cume(spark, sf):
    return ranking.percentile_cume(mart(spark, sf).select("entity_id", "views_delta"), "views_delta", "pct").select("entity_id", "pct")


@register(f"with {MART} select entity_id, round((row_number() over (order by views_delta, entity_id) - 1) / (count(*) over () - 1) * 100.0e0, 4) as pct from mart")
def percentile_ordinal(spark, sf):
    return ranking.percentile_ordinal(mart(spark, sf).select("entity_id", "views_delta"), "views_delta", "entity_id", "pct").select("entity_id", "pct")


@register(f"with {MART} select entity_id, round(100 - (row_number() over (order by views_delta desc, entity_id) - 1) / (count(*) over () - 1) * 100.0e0, 4) as pct from mart")
def percentile_desc(spark, sf):
    return ranking.percentile_ordinal(mart(spark, sf).select("entity_id", "views_delta"), "views_delta", "entity_id", "pct", descending=True).select("entity_id", "pct")


@register(f"with {MART}, a as (select *, median(views_delta) over (partition by group_id) as med from mart), b as (select *, median(abs(views_delta - med)) over (partition by group_id) as mad from a) select entity_id, round(case when mad = 0 then 0 else 0.6745 * (views_delta - med) / mad end, 10) as z from b")
def robust_z(spark, sf):
    m = robust.with_mad(stage(mart(spark, sf).select("entity_id", "group_id", "views_delta")), "views_delta", ["group_id"])
    return m.select("entity_id", F.round(robust.robust_z(F.col("views_delta"), F.col("median"), F.col("mad")), 10).alias("z"))


@register(f"with {MART}, a as (select *, median(views_delta) over (partition by group_id) as med from mart) select group_id, min(med) as med, median(abs(views_delta - med)) as mad from a group by 1")
def mad_by_group(spark, sf):
    return robust.with_mad(stage(mart(spark, sf).select("group_id", "views_delta")), "views_delta", ["group_id"]).groupBy("group_id").agg(F.min("median").alias("med"), F.min("mad").alias("mad"))


@register(f"""with {MART}, g as (select group_id, list_sort(list(views_delta)) as a from mart group by 1) select group_id, case when len(a) >= 2 then a[cast(floor(0.75 * (len(a) - 1)) as int) + 1] - a[cast(floor(0.25 * (len(a) - 1)) as int) + 1] end as iqr,
 a[len(a) // 2 + 1] as upper, a[cast(ceil(0.8 * len(a)) as int)] as q80 from g""")
def iqr_floor_by_group(spark, sf):
    m = stage(mart(spark, sf).select("group_id", "views_delta"))
    q = robust.order_statistics(m, "views_delta", ["group_id"], {"q1": robust.floor_quantile(0.25), "q3": robust.floor_quantile(0.75), "upper": robust.UPPER_MIDDLE, "q80": robust.disc_quantile(0.8)})
    n = robust.joined(m.groupBy("group_id").agg(F.count("views_delta").alias("n")), q, ["group_id"])
    return n.select("group_id", F.when(F.col("n") >= 2, F.col("q3") - F.col("q1")).alias("iqr"), "upper", F.col("q80").cast("bigint").alias("q80"))


@register(f"with {SCORES} select entity_id, growth_pct, relative, relative_pct, eng_pct, freshness, alpha, opportunity, anomaly from scores")
def entity_scores(spark, sf):
    return scores(spark, sf).select("entity_id", "growth_pct", "relative", "relative_pct", "eng_pct", "freshness", "alpha", "opportunity", "anomaly")


_PERIOD = {"daily": ("l_shipdate", "day"), "weekly": ("l_shipdate", "week"), "monthly": ("l_shipdate", "month")}
_SUMS = "cast(sum(cast(l_quantity as bigint)) as bigint) as qty, count(*) as n, cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as discount_points, cast(arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) as bigint) as last_qty"


def _period(spark, sf, grain: str, key: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.to_date(F.date_trunc(grain, "l_shipdate")).alias("period"), F.col(key).alias("key")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("discount_points"), F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).cast("bigint").alias("last_qty"))


def _register_periods() -> None:
    for name, (_, grain) in _PERIOD.items():
        for level, key in (("entity", "l_partkey"), ("group", "l_suppkey")):
            register(f"select cast(date_trunc('{grain}', l_shipdate) as date) as period, {key} as key, {_SUMS} from lineitem group by 1, 2", name=f"period_{name}_{level}")(lambda spark, sf, g=grain, k=key: _period(spark, sf, g, k))


_register_periods()


@register("""select grain, period, cast(sum(cast(l_quantity as bigint)) as bigint) as qty, count(distinct l_partkey) as entities from (
 select 'day' as grain, cast(date_trunc('day', l_shipdate) as date) as period, l_quantity, l_partkey from lineitem union all
 select 'week', cast(date_trunc('week', l_shipdate) as date), l_quantity, l_partkey from lineitem union all
 select 'month', cast(date_trunc('month', l_shipdate) as date), l_quantity, l_partkey from lineitem) group by 1, 2""")
def period_all_grains(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").cast("bigint").alias("q"), F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), F.to_date(F.date_trunc(g, "l_shipdate")).alias("period")) for g in ("day", "week", "month")])).alias("p"))
    return li.groupBy("p.grain", "p.period").agg(F.sum("q").alias("qty"), F.countDistinct("l_partkey").alias("entities"))


@register(f"with {OBS}, m as (select o.entity_id, o.run, (select arg_max(h.views, h.run) from obs h where h.entity_id = o.entity_id and h.run < o.run) as prev_views from obs o) select * from m")
def asof_previous(spark, sf):
    o = obs(spark, sf)
    return asof_backward(o.select("entity_id", "run"), o.select("entity_id", "run", "views"), "entity_id", "run", "run", ["views"]).select("entity_id", "run", "prev_views")


@register("""select a.event_id, arg_min(b.event_id, (abs(epoch_us(b.ts) - epoch_us(a.ts) - 604800000000), epoch_us(b.ts), b.event_id)) as next_event_id from events a join events b on a.user_id = b.user_id
 and abs(epoch_us(b.ts) - epoch_us(a.ts) - 604800000000) <= 172800000000 group by 1""")
def asof_nearest_7d(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return asof_nearest(e, e, "user_id", "ts", "event_id", 7, 2, ["event_id"]).select("event_id", "next_event_id")


_HIST = f"{OBS}, {HISTORY}"


@register(f"with {_HIST} select entity_id, run, velocity from v")
def velocity_history(spark, sf):
    return history(spark, sf).select("entity_id", "run", "velocity")


@register(f"with {_HIST} select entity_id, max(velocity) as peak, round(least(100, arg_max(velocity, run) / greatest(max(velocity), 1) * 100) + 1e-9, 6) as decay from v group by 1")
def peak_decay(spark, sf):
    return history(spark, sf).groupBy("entity_id").agg(F.max("velocity").alias("peak"), S.settled(F.least(F.lit(100.0), F.max_by("velocity", "run") / F.greatest(F.max("velocity"), F.lit(1.0)) * 100)).alias("decay"))


@register(f"""with {_HIST} select entity_id, run, views_delta - prev_delta as acceleration, round(views_delta / greatest(prev_delta, 1.0e0), 6) as ratio,
 case when prev_delta is null then 'unknown' when round(views_delta / greatest(prev_delta, 1.0e0), 6) >= 2 then 'accelerating' when round(views_delta / greatest(prev_delta, 1.0e0), 6) >= 0.8 then 'stable' when round(views_delta / greatest(prev_delta, 1.0e0), 6) >= 0.2 then 'decelerating' else 'fading' end as trend
 from (select entity_id, run, views_delta, cast(prev_delta as double) as prev_delta from v) where prev_delta is not null""")
def acceleration(spark, sf):
    h = history(spark, sf).where("prev_delta is not null").withColumn("ratio", S.barrier(F.col("views_delta") / F.greatest(d(F.col("prev_delta")), F.lit(1.0))))
    return h.select("entity_id", "run", (F.col("views_delta") - d(F.col("prev_delta"))).alias("acceleration"), "ratio", S.trend_label(F.col("ratio")).alias("trend"))


@register(f"""with {_HIST}, r as (select *, row_number() over (partition by entity_id order by run) as rn, count(*) over (partition by entity_id) as n from v),
c as (select *, min(case when comments_delta > 0 then rn end) over (partition by entity_id) as ch from r),
m as (select entity_id, min(n) as n, min(ch) as ch, median(views_delta) filter (where rn < ch) as before, median(views_delta) filter (where rn >= ch) as after from c group by 1)
select entity_id, before, after, round(after / greatest(before, 1.0e0), 6) as lift, case when after / greatest(before, 1.0e0) >= 1.5 then 'positive' when after / greatest(before, 1.0e0) >= 0.8 then 'neutral' else 'negative' end as status from m where n >= 3 and ch > 1 and ch < n""")
def change_lift(spark, sf):
    w = Window.partitionBy("entity_id")
    r = history(spark, sf).withColumn("rn", F.row_number().over(w.orderBy("run"))).withColumn("n", F.count("*").over(w)).withColumn("ch", F.min(F.when(F.col("comments_delta") > 0, F.col("rn"))).over(w))
    m = r.where("n >= 3 and ch > 1 and ch < n").groupBy("entity_id").agg(F.median(F.when(F.col("rn") < F.col("ch"), F.col("views_delta"))).alias("before"), F.median(F.when(F.col("rn") >= F.col("ch"), F.col("views_delta"))).alias("after"))
    lift = F.col("after") / F.greatest(F.col("before"), F.lit(1.0))
    return m.select("entity_id", "before", "after", S.barrier(lift).alias("lift"), S.by_threshold(lift, [(1.5, "positive"), (0.8, "neutral")], "negative").alias("status"))


@register(f"""with {_HIST}, g as (select entity_id, list_sort(list(views_delta)) as a, median(views_delta) as med, count(*) as n from v group by 1)
select entity_id, case when n >= 3 then round((a[cast(floor(0.75 * (n - 1)) as int) + 1] - a[cast(floor(0.25 * (n - 1)) as int) + 1]) / greatest(med, 1.0e0), 6) end as volatility from g""")
def volatility(spark, sf):
    g = obs(spark, sf).groupBy("entity_id").agg(robust.iqr_floor("views_delta").alias("iqr"), F.median("views_delta").alias("med"), F.count("*").alias("n"))
    return g.select("entity_id", F.when(F.col("n") >= 3, S.barrier(F.col("iqr") / F.greatest(F.col("med"), F.lit(1.0)))).alias("volatility"))


@register(f"""with {OBS}, e as (select max(run) as e from obs), g as (select group_id, sum(case when date_diff('day', run, e) between 0 and 90 then views_delta else 0 end) as short, sum(case when date_diff('day', run, e) between 0 and 365 then views_delta else 0 end) as long,
 count(*) filter (where date_diff('day', run, e) between 0 and 90) as n_short from obs, e group by 1), m as (select *, round(short / greatest(long / 365.0e0 * 90, 1.0e0), 6) as momentum from g)
 select group_id, cast(short as bigint) as short, cast(long as bigint) as long, n_short, momentum, {pct_sql('momentum')} as momentum_pct from m""")
def momentum(spark, sf):
    o = obs(spark, sf)
    age = F.datediff("e", "run")
    near = lambda n: F.sum(F.when(age.between(0, n), F.col("views_delta")).otherwise(0))
    g = o.crossJoin(F.broadcast(o.agg(F.max("run").alias("e")))).groupBy("group_id").agg(near(90).alias("short"), near(365).alias("long"), F.count_if(age.between(0, 90)).alias("n_short"))
    g = g.withColumn("momentum", S.barrier(F.col("short") / F.greatest(F.col("long") / 365.0 * 90, F.lit(1.0))))
    return ranking.percentile_tied(g, "momentum", "momentum_pct")


@register(f"""with {OBS}, g as (select group_id, list_sort(list(views_delta)) as a, median(views_delta) as med from obs group by 1), v as (select group_id, round((a[cast(floor(0.75 * (len(a) - 1)) as int) + 1] - a[cast(floor(0.25 * (len(a) - 1)) as int) + 1]) / greatest(med, 1.0e0), 6) as volatility from g)
 select group_id, volatility, 100 - coalesce({pct_sql('volatility')}, 0) as consistency from v""")
def consistency(spark, sf):
    q = robust.order_statistics(stage(obs(spark, sf).select("group_id", "views_delta")), "views_delta", ["group_id"], {"q1": robust.floor_quantile(0.25), "q3": robust.floor_quantile(0.75), "lo": robust.LOWER_MIDDLE, "hi": robust.UPPER_MIDDLE})
    g = q.select("group_id", S.barrier((F.col("q3") - F.col("q1")) / F.greatest((F.col("lo") + F.col("hi")) / 2, F.lit(1.0))).alias("volatility"))
    return ranking.percentile_tied(g, "volatility", "p").select("group_id", "volatility", (100 - S.zero(F.col("p"))).alias("consistency"))


_CUR, _PREV = "date '2000-06-01'", "date '1999-06-01'"
_SNAP = f"""{OBS}, cur as (select entity_id, arg_max(views, run) as views from obs where run <= {_CUR} group by 1), prev as (select entity_id, arg_max(views, run) as views from obs where run <= {_PREV} group by 1)"""


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    o = obs(spark, sf)
    at = lambda day: o.where(F.col("run") <= F.expr(day)).groupBy("entity_id").agg(F.max_by("views", "run").alias("views"))
    return at(_CUR), at(_PREV)


@register(f"with {_SNAP} select c.entity_id, c.views, p.views as prev_views, c.views - p.views as delta, p.entity_id is null as is_new from cur c left join prev p using (entity_id)")
def snapshot_delta(spark, sf):
    cur, prev = _snapshots(spark, sf)
    return cur.join(prev.select("entity_id", F.col("views").alias("prev_views"), F.lit(True).alias("seen")), "entity_id", "left").select("entity_id", "views", "prev_views", (F.col("views") - F.col("prev_views")).alias("delta"), F.col("seen").isNull().alias("is_new"))


@register(f"with {_SNAP} select entity_id from cur where entity_id not in (select entity_id from prev)")
def new_entities(spark, sf):
    cur, prev = _snapshots(spark, sf)
    return cur.join(prev, "entity_id", "left_anti").select("entity_id")


@register("select p_partkey as entity_id from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_shipdate >= timestamp '2000-01-01')")
def unavailable_entities(spark, sf):
    seen = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '2000-01-01'")
    return table(spark, sf, "part").join(seen, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.col("p_partkey").alias("entity_id"))


@register(f"with {OBS} select * from (select run, count(*) as n, cast(sum(views_delta) as bigint) as views_delta from obs group by 1) where run = (select max(run) from obs where run < date '1999-03-15')")
def latest_run_before(spark, sf):
    o = obs(spark, sf)
    last = o.where("run < date '1999-03-15'").agg(F.max("run").alias("run"))
    return o.join(F.broadcast(last), "run", "left_semi").groupBy("run").agg(F.count("*").alias("n"), F.sum("views_delta").alias("views_delta"))  # last: one row


@register("with r as (select cast(ts as date) as dt, min(ts) as ts from events group by 1) select e.event_id, r.dt from events e join r on e.ts = r.ts")
def first_capture_per_day(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("dt"))
    return e.join(e.groupBy("dt").agg(F.min("ts").alias("ts")), ["dt", "ts"]).select("event_id", "dt")


@register("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def registry_dedupe(spark, sf):
    return keep_latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 1")
def upsert_catalog(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    cut = F.expr("timestamp_ntz '1998-01-01'")
    old = keep_latest(o.where(F.col("o_orderdate") < cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return upsert(old, o.where(F.col("o_orderdate") >= cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@register("select o_custkey, max(o_orderdate) as last_seen, max(o_orderdate) + interval 183 days >= timestamp '2001-06-01' as active from orders group by 1")
def expiry_filter(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_seen"))
    return g.withColumn("active", F.col("last_seen") + F.expr("interval 183 days") >= F.expr("timestamp_ntz '2001-06-01'"))


@register("""select coalesce(a.k, b.k) as k, case when b.k is not null then b.v else a.v end as v, a.x, b.y from (select c_custkey as k, c_mktsegment as v, c_nationkey as x from customer) a
 full join (select o_custkey as k, case when max(o_orderstatus) = 'P' then '' else max(o_orderstatus) end as v, count(*) as y from orders group by 1) b on a.k = b.k""")
def merge_right(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_nationkey").alias("x"))
    status = F.max("o_orderstatus")
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.when(status == "P", "").otherwise(status).alias("v"), F.count("*").alias("y"))
    return merge_right_biased(a, b, "k")


@register("select r_regionkey as k, r_name as v from region union all select n_nationkey, n_name from nation where n_nationkey not in (select r_regionkey from region)")
def timeline_append(spark, sf):
    return append_absent(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), ["k"])
