"""Labels, addresses, times, templates and nested picks, over small texts dealt to the rows of ``events`` and ``customer``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricmart.functions import labels as L
from metricmart.plans.bindings import table
from metricmart.plans.registry import register


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _dealt_sql(texts: list[str], row: str) -> str:
    return f"list_extract([{', '.join(map(_quoted, texts))}], cast({row} % {len(texts)} + 1 as integer))"


def _dealt(texts: list[str], row: str) -> Column:
    return F.element_at(F.array(*map(F.lit, texts)), (F.col(row) % len(texts) + 1).cast("int"))


def _rules_sql(x: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({x}), {_quoted(p)}) then '{k}'" for k, p in rules) + f" else '{otherwise}' end"


_ERRORS = ["ERROR: Requested format is not available", "Sign in to confirm your age", "Private video", "HTTP Error 429: Too Many Requests", "Service temporarily unavailable", "read timed out", "", "something else"]


@register(f"with e as (select event_id, {_dealt_sql(_ERRORS, 'event_id')} as said from events) select event_id, {_rules_sql('said', L.ERROR_RULES, 'unknown')} as error_class from e")
def error_class(spark, sf):
    return table(spark, sf, "events").select("event_id", L.first_rule(_dealt(_ERRORS, "event_id"), L.ERROR_RULES, "unknown").alias("error_class"))


_FEATURES = ["title_length", "Hook_score", "news_semantic", "lsa_3", "x_lsa_3", "cluster_id", "topic_growth", "channel_size", "comment_rate", "video_age", "duration_bucket", "hybrid_rank", "other"]


@register(f"with e as (select value, {_dealt_sql(_FEATURES, 'event_id')} as feature from events), f as (select {_rules_sql('feature', L.FEATURE_RULES, 'engagement_context')} as feature_group, feature, value from e) select feature_group, count(distinct feature) as features, count(*) as n, round(sum(value), 3) as importance from f group by 1")
def feature_group_importance(spark, sf):
    e = table(spark, sf, "events").select(_dealt(_FEATURES, "event_id").alias("feature"), "value")
    by_feature = e.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    g = by_feature.groupBy(L.first_rule(F.col("feature"), L.FEATURE_RULES, "engagement_context").alias("feature_group"))
    return g.agg(F.count("*").alias("features"), F.sum("n").alias("n"), F.round(F.sum("v"), 3).alias("importance"))


_URLS = ["https://www.youtube.com/@some/", "HTTPS://M.YouTube.com/channel/UC12/about?x=1", "https://youtube.com/", "https://example.org/@some", "no address", " https://youtube.com/c/name ", "https://youtube.com/channel/UC9#top"]


@register(
    f"with u as (select c_custkey, trim({_dealt_sql(_URLS, 'c_custkey')}) as url from customer), p as (select c_custkey, case when regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), 'www\\.', '') in ('youtube.com', 'm.youtube.com') then nullif(rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), '') end as path from u)"
    " select c_custkey, path, case when path like '/@%' then 'handle' when path like '/channel/%' then 'channel_id' end as kind, case when path like '/@%' then path[3:] when path like '/channel/%' then path[10:] end as target from p"
)
def url_targets(spark, sf):
    p = table(spark, sf, "customer").select("c_custkey", L.url_path(_dealt(_URLS, "c_custkey")).alias("path"))
    kind, target = L.url_target(F.col("path"))
    return p.select("c_custkey", "path", kind.alias("kind"), target.alias("target"))


_TIMES = ["2024-03-01T10:00:00Z", "2024-03-01T10:00:00+02:00", "2024-03-01T10:00:00", "2024-03-01T10:00:00.250-06:00", "not a time", ""]


@register(f"with t as (select event_id, {_dealt_sql(_TIMES, 'event_id')} as x from events) select event_id, epoch_us(try_cast(case when regexp_matches(x, '(Z|[+-]\\d\\d:\\d\\d)$') then x else x || 'Z' end as timestamptz)) as micros from t")
def iso_times(spark, sf):
    return table(spark, sf, "events").select("event_id", F.unix_micros(L.iso_time(_dealt(_TIMES, "event_id"))).alias("micros"))


_TEMPLATES = ["{topic}: what changed", "Why {topic} matters", "{topic}"]


@register(f"with t as (select c_custkey, c_mktsegment, case when c_custkey % 2 = 0 then ' ' || lower(c_mktsegment) else c_name end as source, i, replace(list_extract([{', '.join(map(_quoted, _TEMPLATES))}], i), '{{topic}}', c_mktsegment) as x from customer, (select cast(unnest([1, 2, 3]) as integer) as i)) select c_custkey, i as place, case when lower(trim(x)) = lower(trim(source)) then x || ' - análisis actualizado' else x end as title from t")
def title_candidates(spark, sf):
    source = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.col("c_name"))
    made = F.array(*[F.struct(F.lit(i).alias("place"), L.filled_template(t, F.col("c_mktsegment"), source).alias("title")) for i, t in enumerate(_TEMPLATES, 1)])
    return table(spark, sf, "customer").select("c_custkey", F.inline(made))


_PICTURES = ['{"default":{"url":"d"},"high":{"url":"h"}}', '{"maxres":{"url":""},"medium":{"url":"m"},"default":{"url":"d"}}', '{"maxres":null}', "{}", '{"default":{"url":"d"},"maxres":{"url":"x"}}']


@register(f"with t as (select c_custkey, cast({_dealt_sql(_PICTURES, 'c_custkey')} as json) as j from customer) select c_custkey, coalesce(nullif(j->'maxres'->>'url', ''), nullif(j->'high'->>'url', ''), nullif(j->'medium'->>'url', ''), nullif(j->'default'->>'url', ''), '') as url from t")
def nested_pick(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", L.nested_pick(_dealt(_PICTURES, "c_custkey"), L.THUMBNAILS).alias("url"))


_PAYLOADS = ['{"summary":"s","claims":[]}', '{"summary":null,"claims":[{"a":1}]}', '{"summary":"s","claims":"[x"}', '{"claims":[1]}', "{}", '{"summary":"s"}']


@register(f"with t as (select c_custkey, cast({_dealt_sql(_PAYLOADS, 'c_custkey')} as json) as j from customer) select c_custkey, coalesce(list_contains(json_keys(j), 'summary') and list_contains(json_keys(j), 'claims') and json_type(j, '$.claims') = 'ARRAY', false) as valid from t")
def required_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", L.has_keys(_dealt(_PAYLOADS, "c_custkey"), ["summary", "claims"], "claims").alias("valid"))
