"""Sorts with missing values, unions that keep their order, term weights, derived targets and composite scores by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.functions import text as T
from metricmart.operators import ranking, robust
from metricmart.plans.bindings import MART, OBS, SCORES, mart, obs, scores, table
from metricmart.plans.model_queries import _EVAL, evaluated
from metricmart.plans.registry import register
from metricmart.plans.text_queries import _TITLE, _TOK, docs
from metricmart.session import stage

# sorts (the k first rows are what these are for)


@register("select p_partkey, case when p_partkey % 5 <> 0 then p_size end as size from part order by 2 desc nulls last, 1 limit 50")
def sort_missing_last(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("size"))
    return p.orderBy(F.desc_nulls_last("size"), "p_partkey").limit(50)


@register("select p_partkey, case when p_partkey % 5 <> 0 then p_size - 3 end as margin from part order by coalesce(margin, -1) desc, 1 limit 50")
def sort_missing_as_low(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") - 3).alias("margin"))
    return p.orderBy(F.coalesce("margin", F.lit(-1)).desc(), "p_partkey").limit(50)


@register(f"with {OBS} select entity_id, run, views_delta from obs order by run desc, views_delta desc, entity_id limit 100")
def sort_period_then_delta(spark, sf):
    return obs(spark, sf).select("entity_id", "run", "views_delta").orderBy(F.desc("run"), F.desc("views_delta"), "entity_id").limit(100)


# unions and lookups


@register("select o_custkey, min(turn) as source from (select o_custkey, 0 as turn from orders where o_orderstatus = 'F' union all select o_custkey, 1 from orders where o_orderstatus = 'O') group by 1")
def ordered_union(spark, sf):
    """Keys of the first table, then those that only the second has."""
    o = table(spark, sf, "orders")
    turns = [o.where(F.col("o_orderstatus") == s).select("o_custkey", F.lit(i).alias("turn")) for i, s in enumerate(("F", "O"))]
    return reduce(DataFrame.unionByName, turns).groupBy("o_custkey").agg(F.min("turn").alias("source"))


@register("select c_custkey as k, c_name as name, c_mktsegment as segment from customer union all select s_suppkey, s_name, null from supplier")
def concatenated_files(spark, sf):
    """Rows of several files by column name; a column that a file lacks is NULL."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return c.unionByName(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)


@register("""select o_orderkey, c_name, n_name, r_name from orders left join (select * from customer where c_custkey % 4 <> 0) on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def chained_lookups(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select("c_custkey", "c_name", "c_nationkey")
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, sf, "region").select("r_regionkey", "r_name")
    both = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@register(f"with {MART}, g as (select group_id, round(avg(eng) * 100, 6) as confidence from mart where bucket <> 'short' group by 1) select entity_id, case when g.group_id is not null then g.confidence else round(eng * 100, 6) end as confidence from mart m left join g on g.group_id = m.group_id")
def group_override(spark, sf):
    """Rows with their group's row merged last: where there is one its confidence wins over the row's own."""
    m = mart(spark, sf).select("entity_id", "group_id", "bucket", "eng")
    g = m.where("bucket <> 'short'").groupBy(F.col("group_id").alias("g")).agg(S.barrier(F.avg("eng") * 100).alias("confidence"))
    own = S.barrier(F.col("eng") * 100)
    return m.join(g, F.col("group_id") == F.col("g"), "left").select("entity_id", F.when(F.col("g").isNotNull(), F.col("confidence")).otherwise(own).alias("confidence"))


@register("select l_orderkey, l_linenumber from lineitem where l_partkey in (select p_partkey from part where p_size > 45)")
def matching_ids(spark, sf):
    wanted = table(spark, sf, "part").where("p_size > 45").select("p_partkey")
    return table(spark, sf, "lineitem").join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


# rollups


@register(f"with {OBS} select entity_id, cast(date_trunc('quarter', run) as date) as period, cast(sum(views_delta) as bigint) as views_delta, round(avg(views), 6) as avg_views, count(*) as snapshots, arg_max(views, run) as last_views from obs group by 1, 2")
def period_snapshots(spark, sf):
    """An entity's period: sums, the average over its snapshots, and what the latest one says."""
    period = F.to_date(F.date_trunc("quarter", "run")).alias("period")
    return obs(spark, sf).groupBy("entity_id", period).agg(F.sum("views_delta").alias("views_delta"), S.barrier(F.avg("views")).alias("avg_views"), F.count("*").alias("snapshots"), F.max_by("views", "run").alias("last_views"))


@register("""with r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as k from orders)
 select o_orderpriority as kind, count(*) as n, round(avg(o_totalprice), 2) as avg_price, count(*) filter (where o_totalprice > 300000) as n_high, array_to_string(list(o_orderkey order by k) filter (where k <= 5), '|') as top5 from r group by 1""")
def kind_summary(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    totals = o.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"), F.count_if(F.col("o_totalprice") > 300000).alias("n_high"))
    from metricmart.plans.record_queries import _ranked

    best = _ranked(o, "o_orderpriority", F.desc("o_totalprice"), "o_orderkey", most=5)  # five a kind, cut before the shuffle too
    best = best.groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), "|").alias("top5"))
    return totals.join(best, F.col("kind") == F.col("o_orderpriority")).select("kind", "n", "avg_price", "n_high", "top5")


@register(f"""with {OBS}, r as (select run, count(*) as n from obs group by 1), f as (select greatest(date_diff('day', min(run), max(run)), 1) as days, arg_min(n, run) as first_n, arg_max(n, run) as last_n, count(*) as runs from r),
 g as (select *, (last_n - first_n) / cast(days as double) as growth from f)
 select case when runs < 2 then 'insufficient_history' when growth <= 0 then 'no_positive_growth' else 'ok' end as status, round(growth, 6) as growth_per_day, case when runs >= 2 and growth > 0 then round(greatest(1000000 - last_n, 0) / growth, 2) end as days_left from g""")
def growth_forecast(spark, sf):
    """Linear from the first to the last run: days until a million rows a run."""
    r = obs(spark, sf).groupBy("run").agg(F.count("*").alias("n"))
    f = r.agg(F.greatest(F.datediff(F.max("run"), F.min("run")), F.lit(1)).alias("days"), F.min_by("n", "run").alias("first_n"), F.max_by("n", "run").alias("last_n"), F.count("*").alias("runs"))
    g = f.withColumn("growth", (F.col("last_n") - F.col("first_n")) / F.col("days").cast("double"))
    ok = (F.col("runs") >= 2) & (F.col("growth") > 0)
    status = F.when(F.col("runs") < 2, "insufficient_history").when(~ok, "no_positive_growth").otherwise("ok")
    return g.select(status.alias("status"), S.barrier(F.col("growth")).alias("growth_per_day"), F.when(ok, F.round(F.greatest(1000000 - F.col("last_n"), F.lit(0)) / F.col("growth"), 2)).alias("days_left"))


@register(f"with {MART}, m as (select *, median(views_delta) over (partition by group_id) as med from mart) select entity_id, round(ln(1 + greatest(views_delta, 0)) - ln(1 + greatest(med, 0)), 6) as log_ratio, round(views_delta / greatest(med, 1.0e0), 6) as ratio from m")
def group_relative_log(spark, sf):
    m = stage(mart(spark, sf).select("entity_id", "group_id", "views_delta"))
    m = robust.joined(m, robust.medians(m, "views_delta", ["group_id"], "med"), ["group_id"])
    log = lambda x: F.log1p(F.greatest(F.col(x).cast("double"), F.lit(0.0)))
    return m.select("entity_id", S.barrier(log("views_delta") - log("med")).alias("log_ratio"), S.barrier(F.col("views_delta") / F.greatest("med", F.lit(1.0))).alias("ratio"))


# text


_PHRASES = ("of the", "in the")


@register(f"""with t as (select doc_id, {_TITLE} as t, {_TOK.format(x=_TITLE)} as w from documents) select doc_id, list_has_any(w, ['the', 'new']) or contains(lower(t), 'of the') or contains(lower(t), 'in the') as has_term,
 regexp_matches(t, '\\b(19|20)[0-9][0-9]\\b') as has_year, contains(t, '?') or contains(t, '¿') as has_question, regexp_matches(t, '(?i)\\b(usd|eur|mxn|cop|ars)\\b') as has_currency from t""")
def phrase_flags(spark, sf):
    """Words by token, phrases by substring; a year, a question mark of either kind, a currency code."""
    t = F.col("title")
    word = F.arrays_overlap(T.tokens(t), F.array(F.lit("the"), F.lit("new")))
    term = reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(p)) for p in _PHRASES], word)
    return docs(spark, sf).select("doc_id", term.alias("has_term"), t.rlike(r"\b(19|20)[0-9][0-9]\b").alias("has_year"), (F.contains(t, F.lit("?")) | F.contains(t, F.lit("¿"))).alias("has_question"), t.rlike(r"(?i)\b(usd|eur|mxn|cop|ars)\b").alias("has_currency"))


_GRAMS = f"""t as (select doc_id, [x for x in {_TOK.format(x=_TITLE)} if length(x) >= 2] as w from documents), g as (select doc_id, unnest(w || [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as term from t),
tf as (select doc_id, term, count(*) as tf from g group by 1, 2), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from documents),
x as (select doc_id, term, tf * (ln((1 + n) / cast(1 + df as double)) + 1) as v from tf join df using (term), n)"""


def term_weights(grams: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, term, weight: counts times ln((1 + n) / (1 + df)) + 1, each document's weights of length 1. ``grams``: doc_id, term."""
    tf = grams.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    v = tf.join(df, "term").crossJoin(F.broadcast(documents.agg(F.count("*").alias("n")))).withColumn("v", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df")).cast("double")) + 1))  # one row
    v = v.select("doc_id", "term", "v")
    length = v.groupBy(F.col("doc_id").alias("d")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    return v.join(length, F.col("doc_id") == F.col("d")).select("doc_id", "term", S.settled(F.col("v") / F.col("length")).alias("weight"))


@register(f"with {_GRAMS} select doc_id, term, round(v / sqrt(sum(v * v) over (partition by doc_id)) + 1e-9, 6) as weight from x")
def tfidf_word_pairs(spark, sf):
    """Words of two letters or more and pairs of them in titles."""
    d = docs(spark, sf)
    w = d.select("doc_id", F.filter(T.tokens(F.col("title")), lambda x: F.length(x) >= 2).alias("w"))
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.element_at("w", (i + 2).cast("int"))))
    return term_weights(w.select("doc_id", F.explode(F.concat("w", pairs)).alias("term")), d)


_CHARS = f"""t as (select doc_id, unnest({_TOK.format(x=_TITLE)}) as w from documents), p as (select doc_id, ' ' || w || ' ' as w from t), g as (select distinct doc_id, unnest(flatten([[substring(w, i, k) for i in range(1, length(w) - k + 2)] for k in [3, 4, 5]])) as term from p)"""


@register(f"with {_CHARS} select term, count(*) as df, round(ln((1 + (select count(*) from documents)) / cast(1 + count(*) as double)) + 1, 6) as idf from g group by 1")
def character_ngrams(spark, sf):
    """Sequences of three to five characters within words (with a blank at either end): how many titles have them, and their weight."""
    d = docs(spark, sf)
    words = d.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("title")))).alias("w")).select("doc_id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))

    def grams(k: int) -> Column:
        starts = F.when(F.length("w") >= k, F.sequence(F.lit(1), F.greatest(F.length("w") - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(F.col("w"), i, F.lit(k)))

    each = words.select("doc_id", F.explode(F.concat(*[grams(k) for k in (3, 4, 5)])).alias("term")).distinct()
    n = d.agg(F.count("*").alias("n"))  # one row
    return each.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", S.barrier(F.log((1 + F.col("n")) / (1 + F.col("df")).cast("double")) + 1).alias("idf"))


@register("""select user_id, cast(to_json(list_sort(list_distinct(list(event_type)))) as varchar) as types, cast(json_object('events', count(*), 'user', user_id) as varchar) as summary from events group by 1""")
def json_texts(spark, sf):
    """An array and a row (keys in order) as JSON text."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"), F.count("*").alias("events"))
    return e.select("user_id", F.to_json("types").alias("types"), F.to_json(F.struct("events", F.col("user_id").alias("user"))).alias("summary"))


@register("select user_id, event_type, count(*) as n from events group by 1, 2")
def merged_counters(spark, sf):
    """Two maps of counters added key by key."""
    e = table(spark, sf, "events")

    def counters(rows: DataFrame, out: str) -> DataFrame:
        return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(out))

    both = counters(e.where("value <= 10 or value is null"), "a").join(counters(e.where("value > 10"), "b"), "user_id", "full_outer")
    none = F.create_map().cast("map<string,bigint>")
    total = F.map_zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))
    return both.select("user_id", F.explode(total).alias("event_type", "n"))


@register("""with r as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 10 as batch from events) select user_id, batch, count(*) as n, array_to_string(list(event_id order by event_id), '|') as ids from r group by 1, 2""")
def batches_of_ten(spark, sf):
    from pyspark.sql import Window

    r = table(spark, sf, "events").select("user_id", "event_id", F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 10).alias("batch"))
    return r.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "|").alias("ids"))  # ten at most


# examples and their evaluation


def one_hot(df: DataFrame, columns: list[str], most: int = 12) -> DataFrame:
    """A 0/1 column for each value of the given columns; a column of more than ``most`` values is left out whole."""
    out = df
    for c in columns:
        values = sorted(r[0] for r in df.where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect())  # most + 1 rows
        if len(values) <= most:
            out = out.withColumns({f"{c}={v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("int") for v in values})
        out = out.drop(c)
    return out


@register("select o_orderkey, " + ", ".join(f"""(coalesce(o_orderstatus, '') = '{v}')::int as "o_orderstatus={v}" """ for v in "FOP") + " from orders")
def one_hot_features(spark, sf):
    return one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderkey").cast("string").alias("many")), ["o_orderstatus", "many"])


_PLACE = "(row_number() over (order by {x}, entity_id) - 1) / (count(*) over () - 1) * 100.0e0"
_TARGETS = f"""{MART}, b as (select group_id, list_sort(list(views_delta))[count(*) // 2 + 1] as base from mart group by 1),
t as (select entity_id, round(views_delta / (case when base = 0 then 1 else base end), 6) as relative, cast(likes_delta + comments_delta as double) as engagement, cast(comments_delta as double) as comments from mart join b using (group_id)),
p as (select *, {_PLACE.format(x="relative")} as p1, {_PLACE.format(x="engagement")} as p2, {_PLACE.format(x="comments")} as p3 from t)"""


@register(f"with {_TARGETS} select entity_id, relative, engagement, round((0.55 * p1 + 0.25 * p2 + 0.15 * p3) / 0.95 + 1e-9, 6) as value from p")
def derived_targets(spark, sf):
    """Growth by the group's upper median, engagement, and a weighted mean of places (weights .55, .25, .15 renormalised)."""
    m = stage(mart(spark, sf).select("entity_id", "group_id", "views_delta", "likes_delta", "comments_delta"))
    m = robust.joined(m, robust.order_statistics(m, "views_delta", ["group_id"], {"base": robust.UPPER_MIDDLE}), ["group_id"])
    t = m.select("entity_id", S.barrier(F.col("views_delta") / F.when(F.col("base") == 0, 1).otherwise(F.col("base"))).alias("relative"), (F.col("likes_delta") + F.col("comments_delta")).cast("double").alias("engagement"), F.col("comments_delta").cast("double").alias("comments"))
    for i, x in enumerate(("relative", "engagement", "comments"), 1):
        t = stage(ranking.percentile_ordinal(t, x, "entity_id", f"p{i}", digits=12))
    value = S.weighted_renormalised((0.55, F.col("p1")), (0.25, F.col("p2")), (0.15, F.col("p3")))
    return t.select("entity_id", "relative", "engagement", S.settled(value).alias("value"))


@register(f"""with {OBS}, c as (select count(*) as n, count(distinct run) as runs, count(distinct group_id) as groups from obs)
 select n, runs, concat_ws('|', case when n < 300 then 'too_few_examples' end, case when runs < 100 then 'short_history' end, case when groups < 50 then 'few_groups' end) as blockers, greatest(1000 - n, 0) as gap from c""")
def readiness_blockers(spark, sf):
    """What still stands in the way, in order, and how many rows are missing."""
    c = obs(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("run").alias("runs"), F.countDistinct("group_id").alias("groups"))
    blockers = F.concat_ws("|", F.when(F.col("n") < 300, "too_few_examples"), F.when(F.col("runs") < 100, "short_history"), F.when(F.col("groups") < 50, "few_groups"))
    return c.select("n", "runs", blockers.alias("blockers"), F.greatest(1000 - F.col("n"), F.lit(0)).cast("long").alias("gap"))


@register(f"""with {_EVAL}, a as (select doc_id, y from e order by score desc, doc_id limit 10), b as (select doc_id, y from e order by chars % 100 desc, doc_id limit 10)
 select (select count(*) from a join b using (doc_id)) as overlap_10, round((select avg(y) from a) - (select avg(y) from b), 6) as lift_over_baseline""")
def eval_overlap_lift(spark, sf):
    """The ten best by the score against the ten best by a baseline column: how many both have, and the gain in precision."""
    e = evaluated(spark, sf)
    a, b = (e.orderBy(order, "doc_id").limit(10).select("doc_id", "y") for order in (F.desc("score"), (F.col("chars") % 100).desc()))
    one = lambda df, out: F.broadcast(df.agg(F.avg("y").alias(out)))  # noqa: E731  one row
    both = a.join(b.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("overlap_10"))
    return both.crossJoin(one(a, "pa")).crossJoin(one(b, "pb")).select("overlap_10", S.barrier(F.col("pa") - F.col("pb")).alias("lift_over_baseline"))


@register(f"with {_EVAL}, r as (select y, row_number() over (order by score desc, doc_id) as k, count(*) over () as n from e) select round(avg(y), 6) as precision, count(*) as n from r where k <= greatest(n // 10, 1)")
def eval_top_decile(spark, sf):
    r = ranking.ordinal_rank(evaluated(spark, sf), "score", "doc_id", "k")
    return r.where(F.col("k") <= F.greatest(F.floor(F.col("k_n") / 10), F.lit(1))).agg(S.barrier(F.avg("y")).alias("precision"), F.count("*").alias("n"))


# composite scores


@register(f"with {SCORES} select bucket, count(*) as n, round(least(100, 0.35 * avg(opportunity) + 0.25 * avg(relative_pct) + 0.20 * avg(alpha) + 0.20 * avg(eng_pct)) + 1e-9, 6) as success from scores group by 1")
def pattern_success(spark, sf):
    means = [(0.35, "opportunity"), (0.25, "relative_pct"), (0.20, "alpha"), (0.20, "eng_pct")]
    return scores(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), S.settled(F.least(F.lit(100.0), S.weighted_sum(*[(w, F.avg(c)) for w, c in means]))).alias("success"))


#: Weights of the creative score's six parts (fixed values).
CREATIVE_WEIGHTS = (0.35, 0.20, 0.15, 0.15, 0.10, 0.05)
_PARTS = ("opportunity", "case when entity_id % 3 <> 0 then relative_pct end", "case when entity_id % 2 = 0 then alpha end", "eng_pct", "case when entity_id % 5 <> 0 then freshness end", "metadata")


@register(f"with {SCORES}, p as (select entity_id, " + ", ".join(f"{p} as x{i}" for i, p in enumerate(_PARTS)) + " from scores) select entity_id, round(least(greatest((" + " + ".join(f"coalesce({w}e0 * x{i}, 0)" for i, w in enumerate(CREATIVE_WEIGHTS)) + ") / (" + " + ".join(f"case when x{i} is null then 0 else {w}e0 end" for i, w in enumerate(CREATIVE_WEIGHTS)) + "), 0), 100) + 1e-9, 4) as score from p")
def creative_execution(spark, sf):
    """Weighted mean over the parts that are there, from 0 to 100; 0 if none is."""
    value = S.weighted_renormalised(*[(w, F.expr(p)) for w, p in zip(CREATIVE_WEIGHTS, _PARTS)])
    return scores(spark, sf).select("entity_id", F.round(S.clamp(S.zero(value)) + 1e-9, 4).alias("score"))


_KIND = f"""{SCORES}, k as (select entity_id, relative_pct as saturation, opportunity, eng_pct as tutorial, case entity_id % 6 when 0 then 'create_fast_reaction' when 1 then 'create_evergreen' when 2 then 'repackage_idea' when 3 then 'monitor_next_run' else 'compare' end as action from scores)"""


@register(f"""with {_KIND} select entity_id, case action when 'create_fast_reaction' then 'fast_reaction_package' when 'create_evergreen' then 'evergreen_explainer_package' when 'repackage_idea' then 'repackage_package'
 else case when saturation >= 70 and opportunity >= 50 then 'contrarian_package' when tutorial >= 60 then 'tutorial_package' when action = 'monitor_next_run' then 'watchlist_package' else 'comparison_package' end end as package from k""")
def package_type(spark, sf):
    """An action that names its package decides; then scores do; watched entities and the rest come last."""
    k = F.col("entity_id") % 6
    named = {0: "fast_reaction_package", 1: "evergreen_explainer_package", 2: "repackage_package"}
    by_action = F.element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), k.cast("int"))
    by_score = F.when((F.col("relative_pct") >= 70) & (F.col("opportunity") >= 50), "contrarian_package").when(F.col("eng_pct") >= 60, "tutorial_package")
    return scores(spark, sf).select("entity_id", F.coalesce(by_action, by_score, F.when(k == 3, "watchlist_package"), F.lit("comparison_package")).alias("package"))
