"""Text, topic and event queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.functions import text as T
from metricmart.operators import ranking, robust
from metricmart.operators.dedupe import mode_first_seen
from metricmart.plans.bindings import table
from metricmart.plans.registry import register
from metricmart.session import stage

_TOK = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_TITLE = "split_part(text, chr(10), 1)"


def docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))


@register(f"""select doc_id, length({_TITLE}) as chars, len({_TOK.format(x=_TITLE)}) as words, regexp_matches({_TITLE}, '[0-9]') as has_digit, contains({_TITLE}, '?') as has_question,
 contains({_TITLE}, ':') as has_colon, contains({_TITLE}, '(') as has_paren, length(text) as text_chars, len({_TOK.format(x='text')}) as text_words from documents""")
def title_features(spark, sf):
    t, has = F.col("title"), lambda c: F.contains("title", F.lit(c))
    return docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("chars"), F.size(T.tokens(t)).cast("long").alias("words"), t.rlike("[0-9]").alias("has_digit"), has("?").alias("has_question"), has(":").alias("has_colon"), has("(").alias("has_paren"), F.length("text").cast("long").alias("text_chars"), F.size(T.tokens(F.col("text"))).cast("long").alias("text_words"))


def _lex_sql(terms: tuple[str, ...]) -> str:
    return "round((" + " + ".join(f"(case when contains(lower(text), '{t}') then 1 else 0 end)" for t in terms) + f") * 100.0e0 / {len(terms)}, 4)"


@register("select doc_id, " + ", ".join(f"{_lex_sql(v)} as {k}" for k, v in T.LEXICON.items()) + " from documents")
def lexicon_scores(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[T.lexicon_score(F.col("text"), v).alias(k) for k, v in T.LEXICON.items()])


_SCORED = "select doc_id, source, " + ", ".join(f"{_lex_sql(v)} as {k}" for k, v in T.LEXICON.items()) + " from documents"
_BEST = "greatest(" + ", ".join(T.LEXICON) + ")"
_HOOK = "case " + " ".join(f"when {k} = {_BEST} and {k} > 0 then '{k}'" for k in T.LEXICON) + " else 'unknown' end"


@register(f"with s as ({_SCORED}) select doc_id, {_HOOK} as hook from s")
def hook_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.arg_max({k: T.lexicon_score(F.col("text"), v) for k, v in T.LEXICON.items()}).alias("hook"))


_PATTERNS = {"numbered": "[0-9]", "question": "[?]", "shouted": "!!", "listed": "[|]", "licensed": "(?i)licen[sc]e", "noisy": "[$%&*#]{3}"}


@register("select doc_id, coalesce(nullif(concat_ws('|', " + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in _PATTERNS.items()) + "), ''), 'unknown') as patterns from documents")
def title_patterns(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _patterns(F.col("text")).alias("patterns"))


def _patterns(x: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws("|", *[F.when(x.rlike(p), F.lit(k)) for k, p in _PATTERNS.items()]), F.lit("")), F.lit("unknown"))


@register("with p as (select source, n_chars, unnest(string_split(coalesce(nullif(concat_ws('|', " + ", ".join(f"case when regexp_matches(text, '{p}') then '{k}' end" for k, p in _PATTERNS.items()) + "), ''), 'unknown'), '|')) as pattern from documents) select pattern, count(*) as n, count(distinct source) as sources, median(n_chars) as median_chars from p group by 1")
def pattern_metrics(spark, sf):
    p = table(spark, sf, "documents").select("source", "n_chars", F.explode(F.split(_patterns(F.col("text")), r"\|")).alias("pattern"))
    p = stage(p)  # a pattern may hold most rows
    return robust.joined(p.groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")), robust.medians(p, "n_chars", ["pattern"], "median_chars"), ["pattern"])


@register("select doc_id, coalesce(round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-z]', '', 'g')), 0), 6), 0) as ratio from documents")
def uppercase_ratio(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.uppercase_ratio(F.col("text")).alias("ratio"))


@register(f"select token, source, count(*) as n from (select source, unnest({_TOK.format(x='text')}) as token from documents) group by 1, 2 order by n desc, token, source limit 120")
def keyword_top(spark, sf):
    t = table(spark, sf, "documents").select("source", F.explode(T.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token", "source").limit(120)


@register(f"with t as (select distinct doc_id, unnest({_TOK.format(x='text')}) as token from documents) select token, count(*) as df, round(ln((1 + (select count(*) from documents)) / (1.0e0 + count(*))) + 1, 6) as idf from t group by 1")
def tfidf_terms(spark, sf):
    d = table(spark, sf, "documents")
    n = d.count()
    return d.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).select("token", "df", S.barrier(F.log((1.0 + n) / (1.0 + F.col("df"))) + 1).alias("idf"))


@register(f"with s as ({_SCORED}) select doc_id, {_HOOK} as topic, round(least(100, 0.60 * {_BEST} + 0.25 * motion + 0.15 * function), 4) as confidence from s")
def topic_assign(spark, sf):
    return _topics(spark, sf).select("doc_id", "topic", "confidence")


def _topics(spark, sf) -> DataFrame:
    lex = {k: T.lexicon_score(F.col("text"), v) for k, v in T.LEXICON.items()}
    s = table(spark, sf, "documents").select("doc_id", "source", "n_chars", *[v.alias(k) for k, v in lex.items()])
    best = F.greatest(*T.LEXICON)
    return s.withColumn("topic", T.arg_max({k: F.col(k) for k in T.LEXICON})).withColumn("confidence", F.round(F.least(F.lit(100.0), 0.60 * best + 0.25 * F.col("motion") + 0.15 * F.col("function")), 4))


_TOPICS = f"s as ({_SCORED.replace('source, ', 'source, n_chars, ', 1)}), t as (select *, {_HOOK} as topic, round(least(100, 0.60 * {_BEST} + 0.25 * motion + 0.15 * function), 4) as confidence from s)"
_METRICS = f"""{_TOPICS}, c as (select topic, source, count(*) as k from t group by 1, 2),
m as (select topic, count(*) as n, count(distinct source) as sources, round(avg(confidence), 3) as avg_confidence, arg_max(doc_id, n_chars * 1000000000 - doc_id) as longest from t group by 1),
u as (select topic, round(max(k) * 100.0e0 / sum(k), 4) as dominant_share, round(100.0e0 / count(*), 4) as density from c group by 1),
topics as (select * from m join u using (topic))"""


def _topic_table(spark, sf) -> DataFrame:
    t = _topics(spark, sf)
    m = t.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))
    u = t.groupBy("topic", "source").agg(F.count("*").alias("k")).groupBy("topic").agg(F.round(F.max("k") * 100.0 / F.sum("k"), 4).alias("dominant_share"), F.round(100.0 / F.count("*"), 4).alias("density"))
    return m.join(u, "topic")


@register(f"with {_METRICS} select * from topics")
def topic_metrics(spark, sf):
    return _topic_table(spark, sf)


_ORDINAL = lambda x: f"case when count(*) over () = 1 then 50.0e0 else round((row_number() over (order by {x}, topic) - 1) / (count(*) over () - 1) * 100.0e0, 4) end"
_PRIMARY = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{k}'" for k, p in _PATTERNS.items()) + " else 'unknown' end"
_SATURATION = f"""{_TOPICS}, d as (select t.*, {_PRIMARY} as pattern, documents.lang as cluster, length(text) as reach from t join documents using (doc_id)),
b as (select topic, count(*) as n, count(distinct source) as sources, round(100.0e0 / count(distinct cluster), 4) as density, round(avg(reach), 6) as speed, round(avg(motion), 6) as eng, round(avg(confidence), 6) as signal, round(avg(function), 6) as alpha, round(avg({_BEST}), 6) as model from d group by 1),
r as (select topic, max(k) as top from (select topic, pattern, count(*) as k from d group by 1, 2) group by 1),
p as (select b.*, round(top * 100.0e0 / n, 4) as repeat, {_ORDINAL('n')} as n_pct, {_ORDINAL('sources')} as source_pct, {_ORDINAL('speed')} as velocity, {_ORDINAL('eng')} as eng_pct from b join r using (topic)),
q as (select *, round(least(100, 0.40 * n_pct + 0.25 * source_pct + 0.20 * density + 0.15 * repeat) + 1e-9, 4) as saturation from p),
o as (select *, round(least(100, 0.35 * velocity + 0.20 * eng_pct + 0.20 * signal + 0.15 * alpha + 0.10 * model + 0.30 * saturation) + 1e-9, 4) as opportunity from q)"""


def _topic_scores(spark, sf) -> DataFrame:
    """Saturation and opportunity of each topic (as in the survey, saturation adds to the opportunity)."""
    primary = F.lit("unknown")
    for k, p in reversed(_PATTERNS.items()):
        primary = F.when(F.col("text").rlike(p), k).otherwise(primary)
    extra = table(spark, sf, "documents").select("doc_id", primary.alias("pattern"), F.col("lang").alias("cluster"), F.length("text").alias("reach"))
    d = stage(_topics(spark, sf).join(extra, "doc_id"))
    mean = lambda c: S.barrier(F.avg(c))
    b = d.groupBy("topic").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(100.0 / F.countDistinct("cluster"), 4).alias("density"), mean("reach").alias("speed"), mean("motion").alias("eng"), mean("confidence").alias("signal"), mean("function").alias("alpha"), mean(F.greatest(*T.LEXICON)).alias("model"))
    r = d.groupBy("topic", "pattern").agg(F.count("*").alias("k")).groupBy("topic").agg(F.max("k").alias("top"))
    p = stage(b.join(r, "topic").withColumn("repeat", F.round(F.col("top") * 100.0 / F.col("n"), 4)))
    for c, name in (("n", "n_pct"), ("sources", "source_pct"), ("speed", "velocity"), ("eng", "eng_pct")):
        p = ranking.percentile_ordinal(p, c, "topic", name)
    capped = lambda *parts: F.round(F.least(F.lit(100.0), S.weighted_sum(*[(w, F.col(c)) for w, c in parts])) + 1e-9, 4)
    p = p.withColumn("saturation", capped((0.40, "n_pct"), (0.25, "source_pct"), (0.20, "density"), (0.15, "repeat")))
    return p.withColumn("opportunity", capped((0.35, "velocity"), (0.20, "eng_pct"), (0.20, "signal"), (0.15, "alpha"), (0.10, "model"), (0.30, "saturation")))


@register(f"with {_SATURATION} select topic, n_pct, source_pct, density, repeat, saturation from o")
def topic_saturation(spark, sf):
    return _topic_scores(spark, sf).select("topic", "n_pct", "source_pct", "density", "repeat", "saturation")


@register(f"""with {_SATURATION} select topic, opportunity, case when velocity >= 75 and saturation < 60 then 'emerging_topic' when signal >= 60 and (n_pct < 35 or n <= 2) then 'semantic_gap' when saturation >= 75 and velocity < 60 then 'saturated_topic'
 when eng >= 0.06 and saturation < 70 then 'evergreen_angle' when velocity >= 60 and signal < 50 then 'watch_topic' else 'low_priority' end as kind from o""")
def topic_opportunity(spark, sf):
    c = F.col
    kind = F.when((c("velocity") >= 75) & (c("saturation") < 60), "emerging_topic").when((c("signal") >= 60) & ((c("n_pct") < 35) | (c("n") <= 2)), "semantic_gap").when((c("saturation") >= 75) & (c("velocity") < 60), "saturated_topic")
    kind = kind.when((c("eng") >= 0.06) & (c("saturation") < 70), "evergreen_angle").when((c("velocity") >= 60) & (c("signal") < 50), "watch_topic").otherwise("low_priority")
    return _topic_scores(spark, sf).select("topic", "opportunity", kind.alias("kind"))


@register(f"with t as (select doc_id, source, list_distinct({_TOK.format(x=_TITLE)}) as a from documents), f as (select source, arg_min(a, doc_id) as b from t group by 1) select doc_id, round(case when len(list_distinct(a || b)) = 0 then 1.0e0 else len(list_intersect(a, b)) / cast(len(list_distinct(a || b)) as double) end, 6) as similarity, case when 100 * len(list_intersect(a, b)) < 40 * len(list_distinct(a || b)) then 'safe' when 100 * len(list_intersect(a, b)) < 70 * len(list_distinct(a || b)) then 'review' else 'risky' end as risk from t join f using (source)")
def jaccard_originality(spark, sf):
    t = docs(spark, sf).select("doc_id", "source", F.array_distinct(T.tokens(F.col("title"))).alias("a"))
    j = t.join(t.groupBy("source").agg(F.min_by("a", "doc_id").alias("b")), "source")
    common, union = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return j.select("doc_id", S.barrier(T.jaccard(F.col("a"), F.col("b"))).alias("similarity"), F.when(100 * common < 40 * union, "safe").when(100 * common < 70 * union, "review").otherwise("risky").alias("risk"))


@register("select text_sha, min(doc_id) as doc_id, count(*) as copies from (select doc_id, sha256(text) as text_sha from documents) group by 1")
def content_cache_skip(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha")).groupBy("text_sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# events


@register("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') is null as no_other from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.missing").isNull().alias("no_other"))


@register("select user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') as types, cast(count(*) as bigint) as n, cast(ceil(count(*) / 50.0e0) as bigint) as batches from events group by 1")
def batch_chunks(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("types"), F.count("*").alias("n"), F.ceil(F.count("*") / 50.0).alias("batches"))


@register("with s as (select user_id, list_sort(list_distinct(list(event_type))) as a, list_sort(list_distinct(list(event_type) filter (where value > 10))) as b from events group by 1) select user_id, a = coalesce(b, []) as same, len(a) as n from s")
def array_compare(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("a"), F.array_sort(F.collect_set(F.when(F.col("value") > 10, F.col("event_type")))).alias("b"))
    return s.select("user_id", (F.col("a") == F.col("b")).alias("same"), F.size("a").cast("long").alias("n"))


@register("select cast(date_trunc('hour', ts) as timestamp) as window_start, event_type, count(*) as n, round(sum(value), 3) as total from events group by 1, 2")
def tumbling_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@register("""with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 21600000000 then 0 else 1 end as fresh from events),
 s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as sid from g) select user_id, min(ts) as started, count(*) as n from s group by user_id, sid""")
def session_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@register("""with a as (select event_type, max(ts) as last from events group by 1), h as (select event_type, (epoch_us((select max(ts) from events)) - epoch_us(last)) / 3600000000.0e0 as hours from a)
 select event_type, round(hours, 6) as hours, case when hours is null then 'not_initialized' when hours > 36 then 'stale' else 'ready' end as state from h""")
def freshness_state(spark, sf):
    e = table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    h = e.groupBy("event_type").agg(F.max("us").alias("last")).crossJoin(F.broadcast(e.agg(F.max("us").alias("now")))).withColumn("hours", (F.col("now") - F.col("last")) / 3600000000.0)  # one row
    return h.select("event_type", S.barrier(F.col("hours")).alias("hours"), F.when(F.col("hours").isNull(), "not_initialized").when(F.col("hours") > 36, "stale").otherwise("ready").alias("state"))


@register("select source, round(avg(((text is not null and text <> '')::int + (lang is not null)::int + (n_chars is not null)::int) * 100.0e0 / 3), 4) as completeness, count(*) as n from documents group by 1")
def completeness_audit(spark, sf):
    d = table(spark, sf, "documents")
    full = (F.coalesce(F.col("text") != "", F.lit(False)).cast("int") + F.col("lang").isNotNull().cast("int") + F.col("n_chars").isNotNull().cast("int")) * 100.0 / 3
    return d.groupBy("source").agg(F.round(F.avg(full), 4).alias("completeness"), F.count("*").alias("n"))


@register("""select kind, count(*) as n from (select case when x is null or x = '' then 'null' when x in ('True', 'False') then 'bool' when regexp_matches(x, '^-?[0-9]+$') then 'int' when regexp_matches(x, '^-?[0-9]+\\.[0-9]+$') then 'float' else 'string' end as kind
 from (select c_name as x from customer union all select cast(c_custkey as varchar) from customer union all select c_mktsegment from customer)) group by 1""")
def type_sniff(spark, sf):
    c = table(spark, sf, "customer")
    x = c.select(F.explode(F.array("c_name", F.col("c_custkey").cast("string"), "c_mktsegment")).alias("x"))
    return x.groupBy(T.sniffed_type(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))


@register("with g as (select p_brand as group_id, count(*) as n from part group by 1) select group_id, cast(1 + 3 + ceil(n / 50.0e0) as bigint) as units, case when 1 + 3 + ceil(n / 50.0e0) > 10 then 'warning' else 'ok' end as level from g")
def quota_estimate(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("group_id")).agg(F.count("*").alias("n"))
    units = F.lit(1) + 3 + F.ceil(F.col("n") / 50.0)
    return g.select("group_id", units.cast("long").alias("units"), F.when(units > 10, "warning").otherwise("ok").alias("level"))


@register("""with c as (select lang, source, count(*) as n, min(doc_id) as f from documents group by 1, 2) select lang, arg_min(source, (-n, f)) as top_source, max(n) as top_source_count from c group by 1""")
def source_modes(spark, sf):
    """The most frequent source of each language, of equally frequent ones the first met."""
    return mode_first_seen(table(spark, sf, "documents"), ["lang"], "source", "doc_id", "top_source")


@register(f"""with {_TOPICS}, p as (select topic, {_PRIMARY} as pattern, doc_id from t join documents using (doc_id)), c as (select topic, pattern, count(*) as n, min(doc_id) as f from p group by 1, 2)
 select topic, arg_min(pattern, (-n, f)) as top_pattern, max(n) as top_pattern_count from c group by 1""")
def topic_modes(spark, sf):
    """The most frequent first pattern of each topic's documents, ties to the one met first."""
    d = _topics(spark, sf).select("doc_id", "topic").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    first = F.lit("unknown")
    for k, p in reversed(_PATTERNS.items()):
        first = F.when(F.col("text").rlike(p), F.lit(k)).otherwise(first)
    return mode_first_seen(d.select("topic", first.alias("pattern"), "doc_id"), ["topic"], "pattern", "doc_id", "top_pattern")
