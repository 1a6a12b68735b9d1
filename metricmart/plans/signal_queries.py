"""Signals, alerts, decisions and client-side views over the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.operators import ranking, robust
from metricmart.plans import mart_queries  # noqa: F401  registers momentum and consistency
from metricmart.plans.bindings import HISTORY, MART, SCORES, history, mart, obs, pct_sql, scores, table
from metricmart.plans.registry import ORACLE_SQL, QUERIES, register
from metricmart.session import stage

#: signal: (condition and score over the advanced table)
_SIGNALS = {
    "alpha_breakout": ("alpha >= 85", "alpha"),
    "trend_burst": ("burst >= 80", "burst"),
    "accelerating": ("trend = 'accelerating' and accel_score >= 70", "accel_score"),
    "evergreen_candidate": ("evergreen >= 75", "evergreen"),
    "packaging_problem": ("packaging >= 70", "packaging"),
    "metadata_change_watch": ("metadata = 100", "greatest(opportunity, 60)"),
    "high_engagement_low_reach": ("eng_pct >= 75 and growth_pct <= 50", "0.65 * eng_pct + 0.35 * (100 - growth_pct)"),
    "low_confidence_metric": ("confidence < 40", "100 - confidence"),
}
#: signal: action, effort, urgency
_ACTIONS = {"alpha_breakout": ("double_down", 1.0, 1.0), "trend_burst": ("follow_up", 0.8, 1.0), "accelerating": ("follow_up", 0.8, 0.9), "evergreen_candidate": ("refresh", 0.6, 0.6), "packaging_problem": ("repackage", 0.8, 0.8), "metadata_change_watch": ("observe", 1.0, 0.5), "high_engagement_low_reach": ("promote", 0.8, 0.7), "low_confidence_metric": ("collect_data", 1.0, 0.4)}
_ACTION_TYPES = sorted({a for a, _, _ in _ACTIONS.values()} | {"archive"})


def advanced(spark, sf) -> DataFrame:
    """Percentiles, horizon scores (NULL outside their ages), burst, evergreen, packaging, confidence and trend of each entity."""
    last = history(spark, sf).groupBy("entity_id").agg(F.max_by("velocity", "run").alias("velocity"), F.max("velocity").alias("peak"), F.max_by("prev_delta", "run").alias("prev_delta"))
    log = lambda x: F.log1p(F.greatest(x.cast("double"), F.lit(0.0)))
    s = stage(scores(spark, sf))
    sizes = robust.joined(s.groupBy("group_id").agg(F.count("*").alias("group_n")), robust.medians(s, "eng", ["group_id"], "group_eng"), ["group_id"])
    s = s.join(last, "entity_id").join(sizes, "group_id")
    s = s.withColumn("log_velocity", S.barrier(log(F.col("velocity")))).withColumn("log_rel", S.barrier(log(F.col("views_delta")) - log(S.zero(F.col("group_median")))))
    s = s.withColumn("log_acc", F.when(F.col("prev_delta").isNotNull(), S.barrier(log(F.col("views_delta") - F.col("prev_delta"))))).withColumn("rel_eng", S.barrier(S.safe_divide(F.col("eng"), F.col("group_eng"))))
    s = s.withColumn("decay", S.settled(F.least(F.col("velocity") / F.greatest(F.col("peak"), F.lit(1.0)), F.lit(1.0)) * 100))
    ratio = F.col("views_delta") / F.greatest(F.col("prev_delta").cast("double"), F.lit(1.0))
    s = s.withColumn("trend", S.trend_label(F.when(F.col("prev_delta").isNotNull(), S.barrier(ratio))))
    s = ranking.percentiles_tied(stage(s), {"log_velocity": "age_pct", "log_rel": "rel_success", "log_acc": "accel_score", "views_per_day": "vpd_pct", "comment_rate": "comment_pct", "rel_eng": "rel_eng_pct"})
    age, weigh = F.col("age_days"), lambda *parts: S.settled(S.weighted_sum(*[(w, F.col(c)) for w, c in parts]))
    s = s.withColumn("short_score", F.when(age <= 3, weigh((0.45, "age_pct"), (0.25, "rel_success"), (0.20, "eng_pct"), (0.10, "comment_pct"))))
    s = s.withColumn("mid_score", F.when(age.between(4, 30), weigh((0.40, "age_pct"), (0.25, "rel_success"), (0.20, "eng_pct"), (0.15, "decay"))))
    s = s.withColumn("long_score", F.when(age.between(31, 180), weigh((0.45, "age_pct"), (0.25, "vpd_pct"), (0.20, "decay"), (0.10, "eng_pct"))))
    s = s.withColumn("overall", F.coalesce("short_score", "mid_score", "long_score"))  # an age has one horizon at most
    s = s.withColumn("burst_base", F.coalesce("short_score", "age_pct")).withColumn("burst", F.when(age <= 7, weigh((0.45, "burst_base"), (0.25, "accel_score"), (0.20, "freshness"), (0.10, "comment_pct"))))
    s = s.withColumn("evergreen", F.when(age >= 30, weigh((0.50, "age_pct"), (0.25, "decay"), (0.15, "vpd_pct"), (0.10, "eng_pct"))))
    packaging = S.clamp(S.weighted_sum((0.50, F.col("eng_pct")), (0.30, F.col("comment_pct")), (0.20, F.col("rel_eng_pct")), (-0.40, F.col("growth_pct"))))
    complete = sum((F.col(c).isNotNull().cast("int") for c in ("eng", "delta_eng", "like_rate", "comment_rate", "alpha")), F.lit(0)) * 100.0 / 5
    confidence = 35 * F.least(F.col("history") / 10.0, F.lit(1.0)) + 0.25 * complete + 20 * F.least(F.col("group_n") / 20.0, F.lit(1.0)) + 0.20 * F.when(F.col("run") == F.col("execution"), 100.0).otherwise(50.0)
    return s.withColumn("packaging", S.settled(packaging)).withColumn("confidence", S.barrier(confidence))


def _weigh_sql(*parts: tuple[float, str]) -> str:
    return "round(" + " + ".join(f"{w!r} * coalesce({c}, 0)" for w, c in parts) + " + 1e-9, 6)"


ADVANCED = (
    SCORES
    + f""", {HISTORY},
hist as (select entity_id, arg_max(velocity, run) as velocity, max(velocity) as peak, arg_max(prev_delta, run) as prev_delta from v group by 1),
a0 as (select scores.*, velocity, peak, prev_delta, count(*) over (partition by group_id) as group_n, median(eng) over (partition by group_id) as group_eng from scores join hist using (entity_id)),
a1 as (select *, round(ln(1 + greatest(velocity, 0)), 6) as log_velocity, round(ln(1 + greatest(views_delta, 0)) - ln(1 + greatest(coalesce(group_median, 0), 0)), 6) as log_rel,
  case when prev_delta is not null then round(ln(1 + greatest(views_delta - prev_delta, 0)), 6) end as log_acc, round(eng / nullif(group_eng, 0), 6) as rel_eng, round(least(velocity / greatest(peak, 1), 1) * 100 + 1e-9, 6) as decay,
  round(views_delta / greatest(cast(prev_delta as double), 1), 6) as acc_ratio from a0),
a2 as (select *, {pct_sql("log_velocity")} as age_pct, {pct_sql("log_rel")} as rel_success, {pct_sql("log_acc")} as accel_score, {pct_sql("views_per_day")} as vpd_pct, {pct_sql("comment_rate")} as comment_pct, {pct_sql("rel_eng")} as rel_eng_pct,
  case when prev_delta is null then 'unknown' when acc_ratio >= 2 then 'accelerating' when acc_ratio >= 0.8 then 'stable' when acc_ratio >= 0.2 then 'decelerating' else 'fading' end as trend from a1),
a3 as (select *, case when age_days <= 3 then {_weigh_sql((0.45, "age_pct"), (0.25, "rel_success"), (0.20, "eng_pct"), (0.10, "comment_pct"))} end as short_score,
  case when age_days between 4 and 30 then {_weigh_sql((0.40, "age_pct"), (0.25, "rel_success"), (0.20, "eng_pct"), (0.15, "decay"))} end as mid_score,
  case when age_days between 31 and 180 then {_weigh_sql((0.45, "age_pct"), (0.25, "vpd_pct"), (0.20, "decay"), (0.10, "eng_pct"))} end as long_score,
  case when age_days >= 30 then {_weigh_sql((0.50, "age_pct"), (0.25, "decay"), (0.15, "vpd_pct"), (0.10, "eng_pct"))} end as evergreen,
  round(least(greatest(0.50 * coalesce(eng_pct, 0) + 0.30 * coalesce(comment_pct, 0) + 0.20 * coalesce(rel_eng_pct, 0) + -0.40 * coalesce(growth_pct, 0), 0), 100) + 1e-9, 6) as packaging,
  round(35 * least(history / 10.0e0, 1) + 0.25 * (((eng is not null)::int + (delta_eng is not null)::int + (like_rate is not null)::int + (comment_rate is not null)::int + (alpha is not null)::int) * 100.0e0 / 5)
    + 20 * least(group_n / 20.0e0, 1) + 0.20 * (case when run = execution then 100.0e0 else 50.0e0 end), 6) as confidence from a2),
advanced as (select *, coalesce(short_score, mid_score, long_score) as overall,
  case when age_days <= 7 then {_weigh_sql((0.45, "coalesce(short_score, age_pct)"), (0.25, "accel_score"), (0.20, "freshness"), (0.10, "comment_pct"))} end as burst from a3)"""
)
_ROWS = " union all ".join(f"select entity_id, group_id, bucket, alpha, opportunity, rel_success, confidence, '{k}' as signal, round(cast({score} as double), 6) as score from advanced where {cond}" for k, (cond, score) in _SIGNALS.items())
SIGNALS = ADVANCED + f", signals as ({_ROWS})"


def signals(spark, sf, entities: DataFrame | None = None) -> DataFrame:
    """One row an entity and triggered signal, in one pass: an array of candidates, exploded. ``entities``: ``advanced``, if made."""
    made = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(k).alias("signal"), F.round(F.expr(score).cast("double"), 6).alias("score"))) for k, (cond, score) in _SIGNALS.items()]))
    return (advanced(spark, sf) if entities is None else entities).select("entity_id", "group_id", "bucket", "alpha", "opportunity", "rel_success", "confidence", F.explode(made).alias("s")).select("*", "s.*").drop("s")


_ADVANCED_COLUMNS = ["entity_id", "age_pct", "comment_pct", "rel_success", "accel_score", "decay", "trend", "short_score", "mid_score", "long_score", "overall", "burst", "evergreen", "packaging"]


@register(f"with {ADVANCED} select {', '.join(_ADVANCED_COLUMNS)} from advanced")
def advanced_entity(spark, sf):
    return advanced(spark, sf).select(_ADVANCED_COLUMNS)


@register(f"with {ADVANCED} select group_id, count(*) as n, round(avg(overall), 3) as avg_overall, median(packaging) as median_packaging, arg_max(entity_id, (opportunity, -entity_id)) as best from advanced group by 1")
def advanced_group(spark, sf):
    a = stage(advanced(spark, sf).select("entity_id", "group_id", "overall", "packaging", "opportunity"))
    g = a.groupBy("group_id").agg(F.count("*").alias("n"), F.round(F.avg("overall"), 3).alias("avg_overall"), F.max_by("entity_id", F.struct("opportunity", -F.col("entity_id"))).alias("best"))
    return robust.joined(g, robust.medians(a, "packaging", ["group_id"], "median_packaging"), ["group_id"])


@register(f"with {ADVANCED} select entity_id, confidence, case when confidence >= 70 then 'high' when confidence >= 40 then 'medium' else 'low' end as level from advanced")
def confidence(spark, sf):
    return advanced(spark, sf).select("entity_id", "confidence", S.confidence_level(F.col("confidence")).alias("level"))


@register(f"with {SIGNALS} select entity_id, signal, score from signals")
def signal_candidates(spark, sf):
    return signals(spark, sf).select("entity_id", "signal", "score")


@register(f"with {SIGNALS} select entity_id, count(*) as n, max(score) as top_score, string_agg(signal, '|' order by signal) as signals from signals group by 1")
def entity_signals(spark, sf):
    return signals(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"), F.max("score").alias("top_score"), F.array_join(F.array_sort(F.collect_list("signal")), "|").alias("signals"))


@register(f"with {SIGNALS} select group_id, signal, count(*) as n, round(avg(score), 3) as avg_score from signals group by 1, 2")
def signals_by_group(spark, sf):
    return signals(spark, sf).groupBy("group_id", "signal").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("avg_score"))


#: signal of a group: (condition and score)
_GROUP_SIGNALS = {
    "momentum_up": ("momentum_pct >= 80", "momentum_pct"),
    "high_growth": ("growth_pct >= 80", "growth_pct"),
    "consistent_performer": ("consistency >= 75 and momentum_pct >= 60", "(consistency + momentum_pct) / 2"),
    "volatility_warning": ("consistency <= 30", "100 - consistency"),
}
_GROUPS = f"""mo as ({ORACLE_SQL["momentum"]}), co as ({ORACLE_SQL["consistency"]}),
gr as (with {MART} select m.group_id, count(*) as n, cast(sum(views_delta) as bigint) as growth, avg(eng) as eng, median(views_delta) as med, any_value(runs) as runs from mart m join (select group_id, count(distinct run) as runs from obs group by 1) using (group_id) group by 1),
gs as (select group_id, momentum_pct, consistency, {pct_sql("growth")} as growth_pct,
 round(35 * least(n / 20.0e0, 1) + 25 * least(runs / 20.0e0, 1) + 0.20 * (((n is not null)::int + (growth is not null)::int + (eng is not null)::int + (med is not null)::int) * 25.0e0) + 20, 6) as confidence from gr join mo using (group_id) join co using (group_id))"""


def group_table(spark, sf) -> DataFrame:
    """Momentum, consistency, growth percentile and confidence of each group."""
    m = stage(mart(spark, sf).select("group_id", "views_delta", "eng"))
    g = m.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("views_delta").alias("growth"), F.avg("eng").alias("eng"))
    g = robust.joined(g, robust.medians(m, "views_delta", ["group_id"], "med"), ["group_id"])
    runs = obs(spark, sf).groupBy("group_id").agg(F.countDistinct("run").alias("runs"))
    g = ranking.percentile_tied(stage(g.join(runs, "group_id")), "growth", "growth_pct")
    complete = sum((F.col(c).isNotNull().cast("int") for c in ("n", "growth", "eng", "med")), F.lit(0)) * 25.0
    confidence = 35 * F.least(F.col("n") / 20.0, F.lit(1.0)) + 25 * F.least(F.col("runs") / 20.0, F.lit(1.0)) + 0.20 * complete + 20
    g = g.withColumn("confidence", S.barrier(confidence))
    return g.join(QUERIES["momentum"](spark, sf).select("group_id", "momentum_pct"), "group_id").join(QUERIES["consistency"](spark, sf).select("group_id", "consistency"), "group_id")


@register(f"with {_GROUPS} select group_id, momentum_pct, consistency, growth_pct, confidence from gs")
def group_advanced(spark, sf):
    return group_table(spark, sf).select("group_id", "momentum_pct", "consistency", "growth_pct", "confidence")


@register(f"with {_GROUPS} " + " union all ".join(f"select group_id, '{k}' as signal, round(cast({score} as double), 6) as score, round(cast({score} as double) * (0.5 + 0.5 * confidence / 100), 6) as adjusted from gs where {cond}" for k, (cond, score) in _GROUP_SIGNALS.items()))
def group_signals(spark, sf):
    made = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(k).alias("signal"), F.expr(score).cast("double").alias("raw"))) for k, (cond, score) in _GROUP_SIGNALS.items()]))
    s = group_table(spark, sf).select("group_id", "confidence", F.explode(made).alias("s"))
    return s.select("group_id", "s.signal", S.barrier(F.col("s.raw")).alias("score"), S.barrier(S.adjusted(F.col("s.raw"), F.col("confidence"))).alias("adjusted"))


_SEVERITY = "case when score >= 90 then 'critical' when score >= 75 then 'high' when score >= 55 then 'medium' else 'low' end"


@register(f"with {SIGNALS} select entity_id, signal, {_SEVERITY} as severity, score from signals order by severity, score desc, entity_id, signal")
def alerts_sorted(spark, sf):
    return signals(spark, sf).select("entity_id", "signal", S.severity(F.col("score")).alias("severity"), "score").orderBy("severity", F.desc("score"), "entity_id", "signal")


@register(f"with {SIGNALS} select {_SEVERITY} as severity, signal, count(*) as n from signals group by 1, 2")
def alert_counts(spark, sf):
    return signals(spark, sf).groupBy(S.severity(F.col("score")).alias("severity"), "signal").agg(F.count("*").alias("n"))


_CASE = lambda i: "case signal " + " ".join(f"when '{k}' then {v[i]!r}" for k, v in _ACTIONS.items()) + " end"
ACTIONS = (
    SIGNALS
    + f""",
x0 as (select *, {_CASE(0)} as action, cast({_CASE(1)} as double) as effort, cast({_CASE(2)} as double) as urgency,
  (0.35 * coalesce(score * (0.5 + 0.5 * confidence / 100), 0) + 0.25 * coalesce(opportunity, 0) + 0.20 * coalesce(rel_success, 0) + 0.20 * coalesce(confidence, 0))
   / (case when score is not null then 0.35 else 0 end + case when opportunity is not null then 0.25 else 0 end + case when rel_success is not null then 0.20e0 else 0 end + case when confidence is not null then 0.20e0 else 0 end) as strategic from signals),
actions as (select *, round(least(greatest(0.60 * (strategic * (case when confidence >= 70 then 1.0 when confidence >= 40 then 0.8 else 0.55 end) * urgency * effort) + 0.25 * (score * (0.5 + 0.5 * confidence / 100)) + 0.15 * confidence, 0), 100), 4) as decision from x0)"""
)


def actions(spark, sf, entities: DataFrame | None = None) -> DataFrame:
    rule = lambda i: F.create_map(*[F.lit(x) for k, v in _ACTIONS.items() for x in (k, v[i])])[F.col("signal")]
    x = signals(spark, sf, entities).withColumn("action", rule(0)).withColumn("effort", rule(1)).withColumn("urgency", rule(2))
    adjusted = S.adjusted(F.col("score"), F.col("confidence"))
    strategic = S.weighted_renormalised((0.35, adjusted), (0.25, F.col("opportunity")), (0.20, F.col("rel_success")), (0.20, F.col("confidence")))
    sure = F.when(F.col("confidence") >= 70, 1.0).when(F.col("confidence") >= 40, 0.8).otherwise(0.55)
    return x.withColumn("decision", F.round(S.clamp(0.60 * (strategic * sure * F.col("urgency") * F.col("effort")) + 0.25 * adjusted + 0.15 * F.col("confidence")), 4))


@register(f"with {ACTIONS} select entity_id, signal, action, decision, {_SEVERITY.replace('score', 'decision')} as priority from actions")
def action_candidates(spark, sf):
    return actions(spark, sf).select("entity_id", "signal", "action", "decision", S.severity(F.col("decision")).alias("priority"))


@register(f"with {ACTIONS}, domain as (select unnest({_ACTION_TYPES!r}) as action) select d.action, count(a.action) as n, coalesce(round(avg(decision), 3), 0) as avg_decision from domain d left join actions a on a.action = d.action group by 1")
def opportunity_matrix(spark, sf):
    domain = spark.createDataFrame([(a,) for a in _ACTION_TYPES], "action string")
    totals = actions(spark, sf).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg(F.col("decision").cast("decimal(12,4)")), 3).cast("double").alias("avg_decision"))  # exact: no order of additions decides a tie
    return domain.join(totals, "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n"), S.zero(F.col("avg_decision")).alias("avg_decision"))


@register(f"with {ACTIONS} select entity_id, action, decision from actions where action in ('observe', 'collect_data') order by decision desc, entity_id, signal limit 50")
def watchlist(spark, sf):
    return actions(spark, sf).where(F.col("action").isin("observe", "collect_data")).orderBy(F.desc("decision"), "entity_id", "signal").select("entity_id", "action", "decision").limit(50)


@register(f"with {ACTIONS} select entity_id, action, decision from actions where action in ('double_down', 'follow_up', 'promote', 'repackage') order by decision desc, entity_id, signal limit 50")
def content_opportunities(spark, sf):
    return actions(spark, sf).where(F.col("action").isin("double_down", "follow_up", "promote", "repackage")).orderBy(F.desc("decision"), "entity_id", "signal").select("entity_id", "action", "decision").limit(50)


@register(f"with {ACTIONS}, b as (select entity_id, max(decision) as decision from actions group by 1), m as (select entity_id, alpha from scores), n as (select entity_id, alpha, 100 - (row_number() over (order by alpha desc, entity_id) - 1) / (count(*) over () - 1) * 100.0e0 as p from m) select entity_id, round(p, 4) as model_pct, round(least(greatest(0.6 * round(p, 4) + 0.4 * coalesce(decision, 0), 0), 100), 4) as hybrid from n left join b using (entity_id)")
def hybrid_scores(spark, sf):
    entities = stage(advanced(spark, sf))  # made once for both
    model = ranking.percentile_ordinal(entities.select("entity_id", "alpha"), "alpha", "entity_id", "model_pct", descending=True)
    best = actions(spark, sf, entities).groupBy("entity_id").agg(F.max("decision").alias("decision"))
    return model.join(best, "entity_id", "full_outer").select("entity_id", "model_pct", F.round(S.clamp(S.weighted_sum((0.6, F.col("model_pct")), (0.4, F.col("decision")))), 4).alias("hybrid"))


@register(f"""with {ACTIONS}, c as (select entity_id, max(decision) as decision, max(opportunity) as opportunity, max(alpha) as alpha, bool_or(action = 'double_down') as forced from actions group by 1)
 select entity_id, round((0.30 * decision + 0.20 * opportunity + 0.20 * alpha) / 0.70, 6) as value, forced from c order by forced desc, value desc, entity_id limit 20""")
def selection_queue(spark, sf):
    c = actions(spark, sf).groupBy("entity_id").agg(F.max("decision").alias("decision"), F.max("opportunity").alias("opportunity"), F.max("alpha").alias("alpha"), F.bool_or(F.col("action") == "double_down").alias("forced"))
    value = F.round((0.30 * F.col("decision") + 0.20 * F.col("opportunity") + 0.20 * F.col("alpha")) / 0.70, 6)
    return c.select("entity_id", value.alias("value"), "forced").orderBy(F.desc("forced"), F.desc("value"), "entity_id").limit(20)


@register(f"with {ADVANCED} select entity_id, group_id, bucket, alpha from advanced where bucket = 'mid' and contains(lower(concat_ws(' ', group_id, cast(entity_id as varchar))), 'brand#1')")
def facet_filter(spark, sf):
    return advanced(spark, sf).where((F.col("bucket") == "mid") & F.contains(F.lower(F.concat_ws(" ", "group_id", F.col("entity_id").cast("string"))), F.lit("brand#1"))).select("entity_id", "group_id", "bucket", "alpha")


@register("select distinct p_brand as value from part order by 1")
def facet_values(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("value")).distinct().orderBy("value")


@register(f"with {ADVANCED} select bucket, cast(floor(opportunity / 10) as bigint) as bin, count(*) as n from advanced group by 1, 2")
def histogram(spark, sf):
    return advanced(spark, sf).groupBy("bucket", F.floor(F.col("opportunity") / 10).alias("bin")).agg(F.count("*").alias("n"))
