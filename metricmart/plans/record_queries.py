"""Record rules: fallbacks, filters with reasons, merges of several tables, rollups of rollups, rankings within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.operators.joins import merge_right_biased
from metricmart.plans.bindings import MART, mart, table
from metricmart.plans.registry import register


@register("select c_custkey, coalesce(nullif(case when c_custkey % 3 = 0 then '' else c_mktsegment end, ''), c_name) as label from customer")
def first_non_empty(spark, sf):
    blank = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(F.nullif(blank, F.lit("")), "c_name").alias("label"))


_REASON = "case when age is null then 'missing_age' when history < 3 then 'low_history' when group_n < 3 then 'insufficient_baseline' else 'ok' end"
_REASONED = f"{MART}, g as (select *, count(*) over (partition by group_id) as group_n, case when entity_id % 17 = 0 then null else age_days end as age from mart)"


@register(f"with {_REASONED} select entity_id, {_REASON} as reason, case when {_REASON} = 'ok' then views_per_day end as value from g")
def confidence_reason(spark, sf):
    m = mart(spark, sf)
    g = m.join(m.groupBy("group_id").agg(F.count("*").alias("group_n")), "group_id").withColumn("age", F.when(F.col("entity_id") % 17 != 0, F.col("age_days")))
    reason = F.when(F.col("age").isNull(), "missing_age").when(F.col("history") < 3, "low_history").when(F.col("group_n") < 3, "insufficient_baseline").otherwise("ok")
    return g.select("entity_id", reason.alias("reason"), F.when(reason == "ok", F.col("views_per_day")).alias("value"))


@register("select o_orderkey, o_custkey from orders where o_orderdate >= timestamp '1998-03-01'")
def recency_filter(spark, sf):
    return table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '1998-03-01'").select("o_orderkey", "o_custkey")


@register("""select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'O' and o_orderdate >= (select max(o_orderdate) from orders) - interval 7 days)
 and c_custkey not in (select o_custkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority = '1-URGENT')""")
def cooldown_filter(spark, sf):
    """Neither failed lately nor done or under way."""
    o = table(spark, sf, "orders")
    lately = o.where("o_orderstatus = 'O'").crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now")))).where("o_orderdate >= now - interval 7 days")  # one row
    done = o.where("o_orderstatus in ('F', 'P') and o_orderpriority = '1-URGENT'")
    c = table(spark, sf, "customer").select("c_custkey")
    return c.join(lately, F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("select p_partkey, case when contains(lower(p_brand), 'd#1') then 'd#1' when contains(lower(p_brand), 'brand#3') then 'brand#3' end as handle from part where contains(lower(p_brand), 'd#1') or contains(lower(p_brand), 'brand#3')")
def handle_filter(spark, sf):
    handles = F.array(F.lit("d#1"), F.lit("brand#3"))
    first = F.get(F.filter(handles, lambda h: F.contains(F.lower("p_brand"), h)), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", first.alias("handle")).where("handle is not null")


@register("select o_orderkey from orders where o_orderdate >= (select max(o_orderdate) from orders) - interval 90 days")
def anchored_window(spark, sf):
    o = table(spark, sf, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("last")))).where("o_orderdate >= last - interval 90 days").select("o_orderkey")  # one row


def without_leaks(df: DataFrame, targets: list[str]) -> DataFrame:
    """Feature columns: none that is a target or looks ahead."""
    return df.select([c for c in df.columns if c not in targets and not c.startswith("future_")])


@register("select o_orderkey, o_custkey from orders")
def leakage_rule(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("future_price"), F.col("o_orderstatus").alias("status"))
    return without_leaks(o, ["status"])


_TABLES = """a as (select o_custkey as k, count(*) as n, 'a' as label, 1 as a from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey as k, count(*) as n, case when o_custkey % 2 = 0 then '' else 'b' end as label, 2 as b from orders where o_orderstatus = 'O' group by 1),
c as (select c_custkey as k, -1 as n, 3 as c from customer where c_custkey % 5 = 0)"""


def _three(spark, sf) -> list[DataFrame]:
    o = table(spark, sf, "orders")
    by = lambda status: o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    a, b = by("F").select("k", "n", F.lit("a").alias("label"), F.lit(1).alias("a")), by("O").select("k", "n", F.when(F.col("k") % 2 == 0, "").otherwise("b").alias("label"), F.lit(2).alias("b"))
    return [a, b, table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("n"), F.lit(3).alias("c"))]


@register(f"""with {_TABLES}, ks as (select k from a union select k from b union select k from c)
 select k, case when c.k is not null then c.n when b.k is not null then b.n else a.n end as n, case when b.k is not null then b.label else a.label end as label, a.a, b.b, c.c from ks left join a using (k) left join b using (k) left join c using (k)""")
def merge_many(spark, sf):
    """Any number of tables; a later one wins, with blanks too."""
    return reduce(lambda x, y: merge_right_biased(x, y, "k"), _three(spark, sf))


@register(f"""with {_TABLES} select a.k, case when c.k is not null then c.n when b.k is not null then b.n else a.n end as n, case when b.k is not null then b.label else a.label end as label, a.a, b.b, c.c from a left join b using (k) left join c using (k)""")
def enrich_left(spark, sf):
    """Rows of the first table, enriched by the others from left to right."""
    first, *others = _three(spark, sf)
    return reduce(lambda x, y: merge_right_biased(x, y, "k"), others, first).join(first.select("k"), "k", "left_semi")


@register("""select l.l_orderkey, l.l_linenumber, coalesce(o.o_orderpriority, p.p_type, 'unknown') as label, o.o_orderkey is not null as has_order from lineitem l
 left join (select * from orders where o_orderstatus = 'F') o on l.l_orderkey = o.o_orderkey left join (select * from part where p_size < 25) p on l.l_partkey = p.p_partkey""")
def three_way_fallback(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    p = table(spark, sf, "part").where("p_size < 25").select("p_partkey", "p_type")
    both = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(p, F.col("l_partkey") == F.col("p_partkey"), "left")
    return both.select("l_orderkey", "l_linenumber", F.coalesce("o_orderpriority", "p_type", F.lit("unknown")).alias("label"), F.col("o_orderkey").isNotNull().alias("has_order"))


@register(f"""with {_TABLES}, u as (select k, 0 as o, n, label from a union all select k, 1, n, label from b union all select k, 2, n, null from c)
 select k, arg_max(n, o) as score, arg_min(label, o) filter (where label is not null and label <> '') as label, count(*) as sources from u group by 1""")
def accumulate_sources(spark, sf):
    """Keys of several tables: the last number, the first text that is not blank, and how many tables know the key."""
    u = reduce(lambda x, y: x.unionByName(y), [t.select("k", F.lit(i).alias("o"), "n", (F.col("label") if "label" in t.columns else F.lit(None).cast("string")).alias("label")) for i, t in enumerate(_three(spark, sf))])
    text = F.when(F.col("label") != "", F.col("label"))
    return u.groupBy("k").agg(F.max_by("n", "o").alias("score"), F.min_by("label", F.when(text.isNotNull(), F.col("o"))).alias("label"), F.count("*").alias("sources"))


@register("""with e as (select l_partkey, cast(date_trunc('month', l_shipdate) as date) as period, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty from lineitem group by 1, 2)
 select p_brand as group_id, period, count(*) as entities, cast(sum(qty) as bigint) as qty, round(sum(qty) / sum(n), 6) as avg_qty, arg_max(l_partkey, (qty, -l_partkey)) as top_entity from e join part on l_partkey = p_partkey group by 1, 2""")
def period_rollup(spark, sf):
    """Groups from the entities' periods: averages over all underlying rows (sums and counts are carried), not of averages."""
    li = table(spark, sf, "lineitem").groupBy("l_partkey", F.to_date(F.date_trunc("month", "l_shipdate")).alias("period")).agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    both = li.join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("group_id")), F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("group_id", "period").agg(F.count("*").alias("entities"), F.sum("qty").alias("qty"), S.barrier(F.sum("qty") / F.sum("n")).alias("avg_qty"), F.max_by("l_partkey", F.struct("qty", -F.col("l_partkey"))).alias("top_entity"))


def _ranked(df: DataFrame, by: str, *order, most: int) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("k") <= most)


@register("select p_brand, array_to_string(list(p_name order by p_retailprice desc, p_partkey), ' | ') as examples from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k from part) where k <= 3 group by 1")
def group_examples(spark, sf):
    best = _ranked(table(spark, sf, "part").select("p_brand", "p_name", "p_retailprice", "p_partkey"), "p_brand", F.desc("p_retailprice"), "p_partkey", most=3)  # three a group
    return best.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p_name"))), lambda x: x["p_name"]), " | ").alias("examples"))


@register("select o_custkey, o_orderkey, cast(k as integer) as k from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 5")
def topk_per_group(spark, sf):
    return _ranked(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.desc("o_totalprice"), "o_orderkey", most=5).select("o_custkey", "o_orderkey", "k")


@register("select o_orderpriority as target, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as champion from orders group by 1")
def champion_per_target(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("target")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("champion"))


@register("select o_custkey, o_orderpriority from orders qualify row_number() over (partition by o_custkey order by case when o_orderpriority = '1-URGENT' then 0 else 1 end, o_totalprice desc, o_orderkey) = 1")
def forced_then_ranked(spark, sf):
    """Forced rows before ranked ones, each key once, the first kept."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice", "o_orderkey")
    forced = o.where("o_orderpriority = '1-URGENT'").withColumn("turn", F.lit(0)).unionByName(o.where("o_orderpriority <> '1-URGENT'").withColumn("turn", F.lit(1)))
    return forced.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct("turn", -F.col("o_totalprice"), "o_orderkey")).alias("o_orderpriority"))


@register("select o_orderkey, case o_orderstatus when 'F' then 4 when 'O' then 3 else 1 end as severity_rank from orders order by 2 desc, o_totalprice desc, o_orderkey limit 100")
def severity_rank_sort(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "O", 3).otherwise(1)
    return table(spark, sf, "orders").withColumn("severity_rank", rank).orderBy(F.desc("severity_rank"), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "severity_rank").limit(100)


@register("select cast(isoyear(ts) as varchar) || '-W' || lpad(cast(weekofyear(ts) as varchar), 2, '0') as label, count(*) as n from events group by 1")
def iso_week_labels(spark, sf):
    week = F.weekofyear("ts")
    year = F.year(F.date_add(F.date_trunc("week", F.col("ts")).cast("date"), 3))  # the year of the week's Thursday
    return table(spark, sf, "events").groupBy(F.concat_ws("-W", year.cast("string"), F.lpad(week.cast("string"), 2, "0")).alias("label")).agg(F.count("*").alias("n"))


@register("select user_id, string_agg(event_type, '|' order by first, event_type) as types from (select user_id, event_type, min(ts) as first from events group by 1, 2) group by 1")
def ordered_distinct(spark, sf):
    """Distinct values in the order of their first appearance."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), "|").alias("types"))
