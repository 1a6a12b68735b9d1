"""Title rules, topics, strengths, values, levels and small rules, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.functions import text as T
from metricmart.functions import titles as N
from metricmart.operators import ranking, robust
from metricmart.plans.bindings import MART, mart, table
from metricmart.plans.registry import register
from metricmart.plans.text_queries import _BEST, _HOOK, _METRICS, _SCORED, _topic_table, _topics
from metricmart.session import folder, stage
from metricmart.sources import files, runs

# titles and topics; a document's text stands for a title, its lexicon scores for the semantic ones

_HELD = ", ".join(f"case when {' or '.join(f'''contains(low, '{w}')''' for w in words)} then '{name}' end" for name, words in N.TITLE_WORDS.items())
_PATTERN_LIST = f"""s as ({_SCORED.replace("source, ", "source, n_chars, text, lower(text) as low, ", 1)}),
pats as (select *, list_filter([case when regexp_matches(text, '[0-9]') then 'numbered_list' end, case when contains(text, '?') then 'question' end, case when {_HOOK} = 'legal' then 'warning' end, {_HELD}, case when motion > 0 then 'semantic_ai_tool' end, case when insult > 0 then 'semantic_finance' end], lambda x: x is not null) as found from s),
patterns as (select *, case when len(found) = 0 then ['unknown'] else found end as patterns from pats)"""


def _titled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", "text", F.lower("text").alias("low"))  # once a text
    x, low = F.col("text"), F.col("low")
    lex = {k: T.lexicon_score(x, v, low) for k, v in T.LEXICON.items()}
    d = d.select("doc_id", "source", "n_chars", "text", "low", *[v.alias(k) for k, v in lex.items()])
    hook = F.when(T.arg_max({k: F.col(k) for k in T.LEXICON}) == "legal", "warning")
    return d.withColumn("patterns", N.title_patterns(x, x.rlike("[0-9]"), F.contains(x, F.lit("?")), hook, F.col("motion"), F.col("insult"), low)).drop("low")


@register(f"with {_PATTERN_LIST} select doc_id, patterns[1] as title_pattern_primary, array_to_string(patterns, '|') as title_patterns from patterns")
def ordered_title_patterns(spark, sf):
    """All patterns of each title in the order of the rules, and the first of them."""
    return _titled(spark, sf).select("doc_id", F.col("patterns")[0].alias("title_pattern_primary"), F.array_join("patterns", "|").alias("title_patterns"))


@register(f"""with {_PATTERN_LIST}, p as (select *, unnest(patterns) as pattern from patterns)
 select pattern as title_pattern, count(*) as video_count, sum(n_chars) as total_views_delta, round(avg(motion) + 1e-9, 4) as avg_hybrid, round(avg(function) + 1e-9, 4) as avg_decision,
 round(least(0.35 * avg(motion) + 0.25 * avg(function) + 0.20 * avg(legal) + 0.20 * avg(insult), 100) + 1e-9, 4) as title_pattern_success_score, arg_min(doc_id, doc_id) as first_example from p group by 1""")
def exploded_pattern_success(spark, sf):
    """Metrics and success of each pattern over all documents that have it."""
    p = stage(_titled(spark, sf).drop("text")).select("doc_id", "n_chars", *T.LEXICON, F.explode("patterns").alias("title_pattern"))
    mean = lambda c: F.avg(c)
    return p.groupBy("title_pattern").agg(
        F.count("*").alias("video_count"), F.sum("n_chars").alias("total_views_delta"), F.round(mean("motion") + 1e-9, 4).alias("avg_hybrid"), F.round(mean("function") + 1e-9, 4).alias("avg_decision"),
        N.pattern_success(mean("motion"), mean("function"), mean("legal"), mean("insult")).alias("title_pattern_success_score"), F.min("doc_id").alias("first_example"),
    )


_TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_TITLE_OF = "split_part(text, chr(10), 1)"
_STRENGTHS = f"""with {_PATTERN_LIST}, share as (select patterns[1] as pattern, count(*) as n from patterns group by 1),
c as (select doc_id, {_TITLE_OF} as title, 'all about ' || lower(source) || ' in ' || len(patterns) as candidate, patterns[1] as pattern from patterns),
j as (select *, list_distinct({_TOKENS.format(x="title")}) as a, list_distinct({_TOKENS.format(x="candidate")}) as b from c),
r as (select *, round(case when len(list_distinct(list_concat(a, b))) = 0 then 100.0e0 else len(list_intersect(a, b)) * 100.0e0 / len(list_distinct(list_concat(a, b))) end, 4) as risk, round(n * 100.0e0 / (select count(*) from patterns), 4) as score from j join share using (pattern))
select doc_id, candidate as title_candidate, risk as copy_risk_score, round(greatest(0, 100 - risk), 4) as originality_score, case when risk >= 70 then 'risky' when risk >= 40 then 'review' else 'safe' end as originality_status, round(0.6 * score + 0.4 * round(greatest(0, 100 - risk), 4) + 1e-9, 4) as estimated_strength from r"""


@register(_STRENGTHS)
def title_strengths(spark, sf):
    """A candidate title for each document: what it copies from the title, and its strength (0.6 pattern, 0.4 originality)."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    t = stage(_titled(spark, sf).select("doc_id", "source", title.alias("title"), "patterns")).withColumn("pattern", F.col("patterns")[0])  # rules once
    share = t.groupBy("pattern").agg(F.count("*").alias("n"))  # a row a pattern
    total = t.agg(F.count("*").alias("all"))
    c = t.join(F.broadcast(share), "pattern").crossJoin(F.broadcast(total))
    candidate = F.concat(F.lit("all about "), F.lower("source"), F.lit(" in "), F.size("patterns").cast("string"))
    c = c.select("doc_id", candidate.alias("title_candidate"), F.array_distinct(T.tokens(F.col("title"))).alias("a"), F.array_distinct(T.tokens(candidate)).alias("b"), F.round(F.col("n") * 100.0 / F.col("all"), 4).alias("score"))
    c = c.withColumn("copy_risk_score", F.round(T.jaccard(F.col("a"), F.col("b")) * 100.0, 4))
    c = c.withColumn("originality_score", F.round(F.greatest(100 - F.col("copy_risk_score"), F.lit(0.0)), 4))
    return c.select("doc_id", "title_candidate", "copy_risk_score", "originality_score", N.originality_status(F.col("copy_risk_score")).alias("originality_status"), N.title_strength(F.col("score"), F.col("originality_score")).alias("estimated_strength"))


_RANKED = "list_sort([" + ", ".join(f"struct_pack(s := -{k}, i := {i}, n := '{k}')" for i, k in enumerate(T.LEXICON)) + "])"
_TERMS = "case n1 " + " ".join(f"when '{k}' then {list(v)}" for k, v in T.LEXICON.items()) + " else [] end"
_HITS = "case n1 " + " ".join(f"when '{k}' then {' or '.join(f'''contains(plain, '{t}')''' for t in v)}" for k, v in T.LEXICON.items()) + " else false end"


@register(f"""with s as ({_SCORED.replace("source, ", "source, text, ", 1)}),
r as (select *, {_RANKED} as r, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\x09-\\x0D\\x20]', ' ', 'g'), '[\\x09-\\x0D\\x20]+', ' ', 'g')) as plain from s),
b as (select *, case when r[1].s < 0 then r[1].n else 'unknown' end as n1, case when r[2].s < 0 then r[2].n else 'unknown' end as n2, -r[1].s as best, list_distinct({_TOKENS.format(x=_TITLE_OF)}) as label from r)
select doc_id, n1 as topic_primary, n2 as topic_secondary, case when best > 0 then round(least(0.60 * best + 0.25 * least(least(30.0e0 * len(list_intersect(label, {_TERMS})), 100) + 10, 100) + 0.15 * (case when {_HITS} then 100 else 0 end), 100) + 1e-9, 4) else 0 end as topic_confidence from b""")
def two_topics(spark, sf):
    """The two best topics of each document, and how sure the first is by score, cluster label (the first line's words) and title."""
    d = _topics(spark, sf).select("doc_id", *T.LEXICON).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    first, second, best = N.two_best({k: F.col(k) for k in T.LEXICON})
    d = d.select("doc_id", "text", first.alias("n1"), second.alias("n2"), best.alias("best"), N.plain_text(F.col("text")).alias("plain"), F.array_distinct(T.tokens(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("label"))
    terms, hit = F.array().cast("array<string>"), F.lit(False)
    for k, words in T.LEXICON.items():
        own = F.col("n1") == k
        any_of = F.lit(False)
        for w in words:
            any_of = any_of | F.contains("plain", F.lit(w))
        terms, hit = F.when(own, F.array(*map(F.lit, words))).otherwise(terms), F.when(own, any_of).otherwise(hit)
    shared = F.size(F.array_intersect("label", terms))
    return d.select("doc_id", F.col("n1").alias("topic_primary"), F.col("n2").alias("topic_secondary"), N.topic_confidence(F.col("best"), shared, hit, latent=True).alias("topic_confidence"))


@register(f"with {_METRICS} select doc_id, t.topic, coalesce(m.n, 0) as topic_rows, coalesce(m.dominant_share, 0) as topic_dominant_share from t left join topics m using (topic)")
def topic_metrics_of_rows(spark, sf):
    """Topic metrics written back to each document."""
    metrics = _topic_table(spark, sf).select("topic", F.col("n").alias("topic_rows"), F.col("dominant_share").alias("topic_dominant_share"))  # a row a topic
    return _topics(spark, sf).select("doc_id", "topic").join(F.broadcast(metrics), "topic", "left").fillna(0, ["topic_rows", "topic_dominant_share"])


@register(f"with {_METRICS} select 'topic_' || lpad(cast(row_number() over (order by n desc, topic) as varchar), 3, '0') as topic_id, topic, n from topics")
def topic_ids(spark, sf):
    """Numbered topics, the largest first."""
    t = _topic_table(spark, sf).select("topic", "n")  # a row a topic
    return t.select(F.format_string("topic_%03d", F.row_number().over(Window.orderBy(F.desc("n"), "topic"))).alias("topic_id"), "topic", "n")


# decisions and queues

_RULES = ("click", "purchase")


@register(f"""select event_id, user_id, event_type, case when not coalesce(value > 10, false) then 'triggered=false' else 'unsupported_signal_type' end as reason from events
 where not coalesce(value > 10, false) or coalesce(event_type, '') not in {_RULES}""")
def decision_rejects(spark, sf):
    """Signals that become no decision, with the reason: not triggered, or no rule for them."""
    e = table(spark, sf, "events")
    fired = F.coalesce(F.col("value") > 10, F.lit(False))
    reason = F.when(~fired, "triggered=false").when(~F.coalesce("event_type", F.lit("")).isin(*_RULES), "unsupported_signal_type")
    return e.select("event_id", "user_id", "event_type", reason.alias("reason")).where("reason is not null")


_VALUES = """c as (select c_custkey, c_acctbal, c_nationkey, case when c_custkey % 2 = 0 then c_acctbal / 100 end as decision, case when c_custkey % 3 = 0 then c_nationkey * 4.0e0 end as hybrid, case when c_custkey % 5 = 0 then 150.0e0 end as creative,
 case when c_custkey % 7 <> 0 then c_nationkey * 2.0e0 end as topic, case when c_custkey % 11 <> 0 then c_acctbal / 120 end as alpha, case when c_custkey % 4 = 1 then 80.0e0 end as confidence from customer),
w as (select *, """ + " + ".join(f"coalesce({w}e0 * {x}, 0)" for w, x in ((0.30, "decision"), (0.20, "hybrid"), (0.20, "creative"), (0.15, "topic"), (0.10, "alpha"), (0.05, "confidence"))) + " as total, " + " + ".join(f"case when {x} is null then 0 else {w}e0 end" for w, x in ((0.30, "decision"), (0.20, "hybrid"), (0.20, "creative"), (0.15, "topic"), (0.10, "alpha"), (0.05, "confidence"))) + """ as weight from c),
valued as (select *, coalesce(round(least(greatest(total / nullif(weight, 0), 0), 100) + 1e-9, 4), 0) as value from w)"""  # fmt: skip


def _valued(spark, sf):
    k, some = F.col("c_custkey"), lambda cond, x: F.when(cond, x)
    six = (some(k % 2 == 0, F.col("c_acctbal") / 100), some(k % 3 == 0, F.col("c_nationkey") * 4.0), some(k % 5 == 0, F.lit(150.0)), some(k % 7 != 0, F.col("c_nationkey") * 2.0), some(k % 11 != 0, F.col("c_acctbal") / 120), some(k % 4 == 1, F.lit(80.0)))
    return table(spark, sf, "customer").withColumn("value", N.transcription_value(*six))


@register(f"with {_VALUES} select c_custkey, value from valued")
def transcription_values(spark, sf):
    """Value for transcription from those of six scores that are known."""
    return _valued(spark, sf).select("c_custkey", "value")


@register(f"""with {_VALUES}, f as (select c_custkey, value, row_number() over (order by c_nationkey desc, value desc, c_custkey) as k from valued where c_mktsegment = 'BUILDING' qualify k <= 10),
r as (select c_custkey, value, row_number() over (order by value desc, c_custkey) as k from valued where c_custkey not in (select c_custkey from f) qualify k <= 20)
select row_number() over (order by s, k)::integer as selection_rank, c_custkey, value, case s when 0 then 'forced' else 'ranked' end as selection_source from (select *, 0 as s from f union all select *, 1 from r)""".replace("c_acctbal, c_nationkey, case", "c_acctbal, c_nationkey, c_mktsegment, case", 1))
def capped_queue(spark, sf):
    """Forced rows (ten at most, the newest first), then the twenty of the highest value that aren't among them."""
    v = _valued(spark, sf).select("c_custkey", "value", "c_nationkey", "c_mktsegment")
    forced = v.where("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_nationkey"), F.desc("value"), "c_custkey").limit(10)
    forced = stage(forced.withColumn("k", F.row_number().over(Window.orderBy(F.desc("c_nationkey"), F.desc("value"), "c_custkey"))).withColumn("s", F.lit(0)))  # ten rows
    ranked = v.join(F.broadcast(forced.select("c_custkey")), "c_custkey", "left_anti").orderBy(F.desc("value"), "c_custkey").limit(20)
    ranked = ranked.withColumn("k", F.row_number().over(Window.orderBy(F.desc("value"), "c_custkey"))).withColumn("s", F.lit(1))
    both = forced.select("c_custkey", "value", "k", "s").unionByName(ranked.select("c_custkey", "value", "k", "s"))  # thirty rows
    return both.select(F.row_number().over(Window.orderBy("s", "k")).alias("selection_rank"), "c_custkey", "value", F.when(F.col("s") == 0, "forced").otherwise("ranked").alias("selection_source"))


@register("""with r as (select distinct o_custkey as k from orders), c as (select c_custkey as k, c_name from customer where c_acctbal >= 0)
select r.k, c_name, c.k is not null as cached from r left join c on r.k = c.k""")
def cache_lookup(spark, sf):
    """What is asked for, once each, with what a cache holds of it; the rest is to be fetched."""
    asked = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    held = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), "c_name", F.lit(True).alias("cached"))
    return asked.join(held, "k", "left").select("k", "c_name", F.coalesce("cached", F.lit(False)).alias("cached"))


# levels

_LIMITS = {"soft": 100, "warning": 500, "operational": 1000}


@register("""with m as (select cast(date_trunc('month', l_shipdate) as date) as month, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(*) as n from lineitem group by 1),
u as (select month, parts + suppliers * 2 + cast(ceil(n / 50.0e0) as bigint) as units from m)
select month, units, case when units >= 1000 then 'over_operational_limit' when units >= 500 then 'warning' when units >= 100 then 'soft_warning' else 'ok' end as status, units >= 1000 as abort from u""")
def quota_levels(spark, sf):
    """Units of each month's rows and their level of four."""
    m = table(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))
    units = N.quota_units(F.col("parts"), F.col("suppliers"), F.col("n"), pages=2)
    return m.select("month", units.alias("units")).select("month", "units", N.quota_status(F.col("units"), **_LIMITS).alias("status"), (F.col("units") >= _LIMITS["operational"]).alias("abort"))


_NEEDED = ("1-URGENT", "2-HIGH")


@register(f"""with o as (select o_custkey, count(distinct o_orderpriority) as found, max(o_orderdate) as last from orders where o_orderpriority in {_NEEDED} group by 1),
f as (select c_custkey, coalesce(found, 0) as found, (epoch_us((select max(o_orderdate) from orders)) - epoch_us(last)) / 3600000000.0e0 as hours from customer left join o on c_custkey = o_custkey)
select c_custkey, round(hours, 2) as age_hours, case when found = 0 then 'not_initialized' when hours > 9216 then 'stale_expected' when found < 2 then 'generation_error' else 'ready' end as state from f""")
def freshness_levels(spark, sf):
    """The state of each customer's two kinds of orders: none, too old, one missing, ready."""
    orders = table(spark, sf, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    found = orders.where(F.col("o_orderpriority").isin(*_NEEDED)).groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("found"), F.max("us").alias("last"))
    c = table(spark, sf, "customer").select("c_custkey").join(found, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(F.broadcast(orders.agg(F.max("us").alias("now"))))  # one row
    hours = (F.col("now") - F.col("last")) / 3600000000.0
    return c.select("c_custkey", F.round(hours, 2).alias("age_hours"), N.freshness(F.coalesce("found", F.lit(0)), 2, hours, 9216).alias("state"))


_PLACE = "(row_number() over (order by {x}, entity_id) - 1) / (count(*) over () - 1) * 100.0e0"


@register(f"""with {MART}, t as (select entity_id, cast(views_delta as double) as growth, cast(likes_delta + comments_delta as double) as engagement, cast(comments_delta as double) as comments, case when size % 2 = 0 then size * 2.0e0 else 0 end as confidence from mart),
p as (select *, {_PLACE.format(x="growth")} as p1, {_PLACE.format(x="engagement")} as p2, {_PLACE.format(x="comments")} as p3 from t)
select entity_id, round((0.55 * p1 + 0.25 * p2 + 0.15 * p3 + case when confidence > 0 then 0.05 * confidence else 0 end) / (0.95e0 + case when confidence > 0 then 0.05e0 else 0 end) + 1e-9, 6) as value from p""")
def content_values(spark, sf):
    """Places of growth, engagement and comments and the confidence, weighted .55, .25, .15 and .05 over what is known."""
    m = mart(spark, sf).select("entity_id", F.col("views_delta").cast("double").alias("growth"), (F.col("likes_delta") + F.col("comments_delta")).cast("double").alias("engagement"), F.col("comments_delta").cast("double").alias("comments"), F.when(F.col("size") % 2 == 0, F.col("size") * 2.0).alias("confidence"))
    m = stage(m)
    for i, x in enumerate(("growth", "engagement", "comments"), 1):
        m = stage(ranking.percentile_ordinal(m, x, "entity_id", f"p{i}", digits=12))
    return m.select("entity_id", S.settled(S.weighted_renormalised((0.55, F.col("p1")), (0.25, F.col("p2")), (0.15, F.col("p3")), (0.05, F.col("confidence")))).alias("value"))


# small rules over whole tables

_INTS = "case c_custkey % 5 when 0 then ' ' || c_custkey || ' ' when 1 then '' when 2 then c_name when 3 then '-0' || c_custkey end"


@register(f"select c_custkey, try_cast(nullif(trim({_INTS}), '') as bigint) as whole from customer")
def safe_ints(spark, sf):
    k = F.col("c_custkey")
    x = F.when(k % 5 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 5 == 1, "").when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, F.concat(F.lit("-0"), k.cast("string")))
    return table(spark, sf, "customer").select("c_custkey", S.safe_int(x).alias("whole"))


@register("select doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\x09-\\x0D\\x20]', ' ', 'g'), '[\\x09-\\x0D\\x20]+', ' ', 'g'))) as plain_sha from documents")
def plain_texts(spark, sf):
    """Digests of texts in lower case without punctuation and with single blanks."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(N.plain_text(F.col("text")), 256).alias("plain_sha"))


@register("select doc_id, coalesce(round(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) * 100.0e0 / nullif(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 0), 4), 0) as uppercase_share from documents")
def uppercase_shares(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.uppercase_share(F.col("text")).alias("uppercase_share"))


@register("select o_orderkey, 'alrt_' || substring(sha1(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority || '|' || o_orderkey), 1, 16) as alert_id, 'pkg_' || substring(sha1(o_orderkey || '|' || o_orderstatus), 1, 10) as package_id from orders")
def hashed_ids(spark, sf):
    text = lambda c: F.col(c).cast("string")
    return table(spark, sf, "orders").select("o_orderkey", N.hashed_id("alrt_", 16, text("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), text("o_orderkey")).alias("alert_id"), N.hashed_id("pkg_", 10, text("o_orderkey"), F.col("o_orderstatus")).alias("package_id"))


@register("select user_id, sha256(array_to_string(list_sort(list_distinct(list(event_type))), '|')) as tags_sha from events group by 1")
def tag_fingerprints(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags")).select("user_id", N.tags_fingerprint(F.col("tags")).alias("tags_sha"))


@register("""select p_partkey, cast(case p_partkey % 4 when 0 then p_size * 3600 + p_size * 60 + 7 when 1 then p_size * 86400 + 5 when 2 then p_size * 60 else 0 end as integer) as seconds from part""")
def durations(spark, sf):
    """Seconds of ISO durations; what is none counts 0."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    x = F.when(k % 4 == 0, F.concat(F.lit("PT"), n, F.lit("H"), n, F.lit("M7S"))).when(k % 4 == 1, F.concat(F.lit("P"), n, F.lit("DT5S"))).when(k % 4 == 2, F.concat(F.lit("PT"), n, F.lit("M"))).otherwise(F.concat(n, F.lit(" minutes")))
    return table(spark, sf, "part").select("p_partkey", T.iso_duration_seconds(x).alias("seconds"))


# readers


@register("select cast(ts as date) as day, case when dayofyear(ts) % 7 = 0 then null else count(*) end as n, dayofyear(ts) % 7 <> 0 as valid, case when dayofyear(ts) % 7 = 0 then null else sum(user_id)::bigint end as users from events group by cast(ts as date), dayofyear(ts)".replace("select cast(ts as date) as day, ", "select "))
def json_document_files(spark, sf):
    """One JSON file for each day of events, every seventh day's broken, through the reader of documents."""
    at = folder(spark)
    day = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
    doc = F.when(F.dayofyear("day") % 7 == 0, "{broken").otherwise(F.to_json(F.struct("n", "users")))
    day.select("day", doc.alias("value")).repartition("day").write.partitionBy("day").text(at)
    return files.read_json_documents(spark, f"{at}/*", "n long, users long")


@register("""select o_orderkey as entity_id, cast(o_orderdate as timestamp) as execution_date, case when o_orderkey % 3 = 0 then null else o_orderkey % 50 end as views_delta, o_orderkey % 4 = 0 as is_new from orders where o_orderkey % 9 <> 0""")
def delta_reader(spark, sf):
    """Deltas written as gzipped JSON lines and read by their schema; rows without a readable date are left out."""
    at, k = folder(spark), F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        k.alias("entity_id"), F.when(k % 9 == 0, "later").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("execution_date"),
        F.when(k % 3 == 0, "none").otherwise((k % 50).cast("string")).alias("views_delta"), F.when(k % 2 == 0, (k % 4 == 0)).alias("is_new"),
    )
    files.write_jsonl(o, at, True)
    return runs.read_deltas(spark, at).select("entity_id", "execution_date", "views_delta", "is_new")
