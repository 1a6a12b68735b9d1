"""Supervised examples, evaluation by ranks, and pyspark.ml models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.operators import evaluation, modeling, ranking, robust
from metricmart.operators.joins import asof_nearest
from metricmart.plans.bindings import OBS, obs, scores, table
from metricmart.plans.registry import register
from metricmart.session import stage

_NEXT = f"""{OBS}, near as (select a.entity_id, a.group_id, a.run, a.views_delta, a.views, arg_min(b.views_delta, (abs(date_diff('day', a.run, b.run) - 31), b.run)) as next_delta
 from obs a join obs b on a.entity_id = b.entity_id and abs(date_diff('day', a.run, b.run) - 31) <= 5 group by 1, 2, 3, 4, 5)"""


def examples(spark, sf, o: DataFrame | None = None) -> DataFrame:
    o = (obs(spark, sf) if o is None else o).select("entity_id", "group_id", "run", "views_delta", "views")
    return asof_nearest(o, o, "entity_id", "run", "entity_id", 31, 5, ["views_delta"]).withColumnRenamed("next_views_delta", "next_delta")


_SUP = f"""{_NEXT}, q as (select quantile_disc(next_delta, 0.8) as top from near), u as (select group_id, run, list_sort(list(next_delta))[count(*) // 2 + 1] as mid from near group by 1, 2),
sup as (select entity_id, n.group_id, n.run, views_delta, next_delta, round(ln(1 + next_delta), 6) as log_next, next_delta >= top as is_top, next_delta > mid as beats_group from near n join u on n.group_id = u.group_id and n.run = u.run, q)"""


def supervised(spark, sf, o: DataFrame | None = None) -> DataFrame:
    n = stage(examples(spark, sf, o))
    top = robust.order_statistics(n, "next_delta", [], {"top": robust.disc_quantile(0.8)})  # one row
    mid = robust.order_statistics(n, "next_delta", ["group_id", "run"], {"mid": robust.UPPER_MIDDLE})
    return robust.joined(robust.joined(n, mid, ["group_id", "run"]), top, []).select("entity_id", "group_id", "run", "views_delta", "next_delta", S.barrier(F.log1p(F.col("next_delta").cast("double"))).alias("log_next"), (F.col("next_delta") >= F.col("top")).alias("is_top"), (F.col("next_delta") > F.col("mid")).alias("beats_group"))


@register(f"with {_SUP} select * from sup")
def supervised_examples(spark, sf):
    return supervised(spark, sf)


@register(f"with {_SUP} select count(*) as n, count(distinct next_delta) as distinct_values, round(avg(is_top::int), 6) as top_rate, round(avg(beats_group::int), 6) as beat_rate, case when count(*) < 300 then 'insufficient' when count(*) < 1000 then 'exploratory' else 'ready' end as status from sup")
def target_coverage(spark, sf):
    n = F.count("*")
    return supervised(spark, sf).agg(n.alias("n"), F.countDistinct("next_delta").alias("distinct_values"), S.barrier(F.avg(F.col("is_top").cast("int"))).alias("top_rate"), S.barrier(F.avg(F.col("beats_group").cast("int"))).alias("beat_rate"), F.when(n < 300, "insufficient").when(n < 1000, "exploratory").otherwise("ready").alias("status"))


@register(f"with {OBS}, r as (select run, count(*) as n from obs group by 1) select count(*) as runs, min(run) as first_run, max(run) as last_run, round((arg_max(n, run) - arg_min(n, run)) / greatest(date_diff('day', min(run), max(run)), 1.0e0), 6) as growth_per_day from r")
def readiness(spark, sf):
    r = obs(spark, sf).groupBy("run").agg(F.count("*").alias("n"))
    return r.agg(F.count("*").alias("runs"), F.min("run").alias("first_run"), F.max("run").alias("last_run"), S.barrier((F.max_by("n", "run") - F.min_by("n", "run")) / F.greatest(F.datediff(F.max("run"), F.min("run")).cast("double"), F.lit(1.0))).alias("growth_per_day"))


@register(f"with {OBS}, r as (select entity_id, run, row_number() over (order by run, entity_id) as rn, count(*) over () as n from obs) select case when rn > n - cast(ceil(n * 0.25e0) as bigint) then 'valid' else 'train' end as part, count(*) as rows, min(run) as first_run, max(run) as last_run from r group by 1")
def temporal_split(spark, sf):
    o = obs(spark, sf).withColumn("day", F.unix_date("run").cast("double"))
    r = ranking.ordinal_rank(o, "day", "entity_id", "rn", descending=False)
    part = F.when(F.col("rn") > F.col("rn_n") - F.ceil(F.col("rn_n") * 0.25), "valid").otherwise("train")
    return r.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.min("run").alias("first_run"), F.max("run").alias("last_run"))


_EVAL = "e as (select d.doc_id, l.quality as y, least(d.n_chars / 5000.0e0, 1) as score, cast(d.n_chars as double) as chars from documents d join labels l using (doc_id))"


def evaluated(spark, sf) -> DataFrame:
    d, l = table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return stage(d.join(l, "doc_id").select("doc_id", "y", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"), F.col("n_chars").cast("double").alias("chars")))


@register(f"with {_EVAL}, t as (select * from e order by score desc, doc_id limit 10) select round(avg(y), 6) as precision_10, round(sum(y) / (select sum(y) * 1.0e0 from e), 6) as recall_10, round(avg(y) - (select avg(y) from e), 6) as lift_10 from t")
def eval_precision_recall_k(spark, sf):
    e = evaluated(spark, sf)
    top = e.orderBy(F.desc("score"), "doc_id").limit(10).agg(F.avg("y").alias("p"), F.sum("y").alias("hits"))
    return top.crossJoin(F.broadcast(e.agg(F.sum("y").alias("all"), F.avg("y").alias("base")))).select(S.barrier(F.col("p")).alias("precision_10"), S.barrier(F.col("hits") / F.col("all")).alias("recall_10"), S.barrier(F.col("p") - F.col("base")).alias("lift_10"))  # one row each


@register(f"with {_EVAL}, r as (select row_number() over (order by score desc, doc_id) as a, row_number() over (order by y desc, doc_id) as b from e) select round(1 - 6.0e0 * cast(sum((a - b) * (a - b)) as double) / (count(*) * 1.0e0 * (count(*) * count(*) - 1)), 6) as spearman from r")
def eval_spearman(spark, sf):
    e = evaluated(spark, sf).withColumn("yd", F.col("y").cast("double"))
    a = ranking.ordinal_rank(e, "score", "doc_id", "a").select("doc_id", "a")
    b = ranking.ordinal_rank(e, "yd", "doc_id", "b").select("doc_id", "b")
    n, gap = F.count("*"), F.col("a") - F.col("b")
    return a.join(b, "doc_id").agg(S.barrier(1 - 6.0 * F.sum(gap * gap).cast("double") / (n * 1.0 * (n * n - 1))).alias("spearman"))


@register(f"""with {_EVAL}, r as (select y, score, row_number() over (order by score desc, doc_id) as k, sum(y) over (order by score desc, doc_id rows between unbounded preceding and current row) as tp,
 rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0e0 as ra from e), s as (select sum(y) as p, count(*) - sum(y) as n from e)
 select round((sum(case when y = 1 then ra else 0 end) - min(p) * (min(p) + 1) / 2.0e0) / (min(p) * 1.0e0 * min(n)), 6) as auc, round(sum(case when y = 1 then tp / cast(k as double) else 0 end) / min(p), 6) as average_precision, round(avg((score - y) * (score - y)), 6) as brier from r, s""")
def eval_auc_ap_brier(spark, sf):
    e = evaluated(spark, sf)
    s = e.agg(F.sum("y").alias("p"), (F.count("*") - F.sum("y")).alias("n"))  # one row
    ranks = ranking._by_value(e, "score", 64).select(F.col("score").alias("_s"), (F.col("less") + (F.col("n") + 1) / 2.0).alias("ra"))
    run = ranking.running_sums(e, "score", "doc_id", ["y"]).join(ranks, F.col("score") == F.col("_s")).crossJoin(F.broadcast(s))
    hit = F.col("y") == 1
    auc = (F.sum(F.when(hit, F.col("ra")).otherwise(0)) - F.min("p") * (F.min("p") + 1) / 2.0) / (F.min("p") * 1.0 * F.min("n"))
    ap = F.sum(F.when(hit, F.col("sum_y") / F.col("rank").cast("double")).otherwise(0)) / F.min("p")
    return run.agg(S.barrier(auc).alias("auc"), S.barrier(ap).alias("average_precision"), S.barrier(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y")))).alias("brier"))


@register(f"with {_NEXT} select count(*) as n, round(avg(abs(next_delta - views_delta)), 6) as mae, round(sqrt(avg((next_delta - views_delta) * (next_delta - views_delta) * 1.0e0)), 6) as rmse from near")
def eval_regression(spark, sf):
    gap = F.col("next_delta") - F.col("views_delta")
    return examples(spark, sf).agg(F.count("*").alias("n"), S.barrier(F.avg(F.abs(gap))).alias("mae"), S.barrier(F.sqrt(F.avg(gap * gap * 1.0))).alias("rmse"))


@register(f"with {_EVAL}, r as (select y, row_number() over (order by chars, doc_id) as rn, count(*) over () as n from e), b as (select avg(case when rn <= n // 4 then y end) as lo, avg(case when rn > n - n // 4 then y end) as hi from r) select round(lo, 6) as low_mean, round(hi, 6) as high_mean, case when hi - lo > 0.02 then 'positive' when hi - lo < -0.02 then 'negative' else 'flat' end as direction from b")
def direction_bins(spark, sf):
    r = ranking.ordinal_rank(evaluated(spark, sf), "chars", "doc_id", "rn", descending=False)
    quarter = F.floor(F.col("rn_n") / 4)
    b = r.agg(F.avg(F.when(F.col("rn") <= quarter, F.col("y"))).alias("lo"), F.avg(F.when(F.col("rn") > F.col("rn_n") - quarter, F.col("y"))).alias("hi"))
    return b.select(S.barrier(F.col("lo")).alias("low_mean"), S.barrier(F.col("hi")).alias("high_mean"), F.when(F.col("hi") - F.col("lo") > 0.02, "positive").when(F.col("hi") - F.col("lo") < -0.02, "negative").otherwise("flat").alias("direction"))


# models: rows only


@register()
def kmeans_clusters(spark, sf):
    """Clusters of the embeddings; k is the root of the row count, from 2 to 8."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k = max(2, min(8, int(e.count() ** 0.5)))
    return KMeans(k=k, seed=42).fit(e).transform(e).select("vec_id", F.col("prediction").alias("cluster"))


#: What the suite learns from: the row's own figures and its place in time.
FEATURES = ["views_delta", "likes_delta", "comments_delta", "log_views", "log_now", "eng", "size", "history", "month"]
TARGETS = {"is_top": "classification", "beats_group": "classification", "log_next": "regression"}
BASELINES = {"alpha": "alpha", "views_delta": "views_delta", "decision": "decision"}
DRIVER_TARGETS = {"relative": "regression", "engagement": "regression", "value": "regression"}


def _rows(spark, sf) -> DataFrame:
    """One row an example (entity and run) with features, targets of the run a month on, and the entity's alpha score
    and, as the decision, its opportunity."""
    seen = stage(obs(spark, sf))
    o = seen.withColumn("history", F.row_number().over(Window.partitionBy("entity_id").orderBy("run")))
    now = o.select("entity_id", "run", "size", "likes_delta", "comments_delta", "history", F.log1p(F.col("views").cast("double")).alias("log_views"), S.barrier(S.safe_divide(F.col("likes") + F.col("comments"), F.col("views"))).alias("eng"))
    s = supervised(spark, sf, seen).join(now.hint("merge"), ["entity_id", "run"])
    marks = scores(spark, sf, seen).select("entity_id", "alpha", F.col("opportunity").alias("decision"))
    s = s.join(marks.hint("merge"), "entity_id", "left").withColumn("log_now", F.log1p(F.col("views_delta").cast("double"))).withColumn("month", F.month("run"))
    return stage(s.withColumn("id", F.concat_ws("|", F.lpad(F.col("entity_id").cast("string"), 12, "0"), F.col("run").cast("string"))))


def _split(rows: DataFrame, share: float) -> DataFrame:
    """Adds train: all but the last ``share`` of the rows in the order of time (rounded up)."""
    r = evaluation.ordered(rows.withColumn("day", F.unix_date("run")).withColumn("all", F.lit(0)), ["all"], "day", "id", "at")
    r = r.withColumn("train", F.col("at") <= F.col("at_n") - F.ceil(F.col("at_n") * share)).drop("day", "all", "at", "at_n")
    return r.repartition("id").sortWithinPartitions("id")  # whatever way rows came, models draw alike


def _suite(spark, sf, trees: int = 40):
    rows = stage(_split(_rows(spark, sf), 0.25))
    return (rows, *modeling.suite(rows, FEATURES, TARGETS, ["alpha", "views_delta", "decision"], trees=trees))


@register()
def model_suite_leaderboard(spark, sf):
    """Three families for three targets against three baselines, on the last quarter of the rows."""
    _, predicted, _ = _suite(spark, sf)
    return modeling.leaderboard(predicted, TARGETS, BASELINES)


@register()
def driver_leaderboard(spark, sf):
    """The same for derived targets (growth by the group's upper median, engagement, value), on the last fifth."""
    rows = _rows(spark, sf)
    rows = robust.joined(rows, robust.order_statistics(rows, "next_delta", ["group_id"], {"base": robust.UPPER_MIDDLE}), ["group_id"])
    rows = rows.withColumn("relative", S.barrier(F.col("next_delta") / F.when(F.col("base") == 0, 1).otherwise(F.col("base")))).withColumn("engagement", (F.col("likes_delta") + F.col("comments_delta")).cast("double"))
    places = stage(rows.select("id", "relative", "engagement", F.col("comments_delta").cast("double").alias("comments"), F.lit(0).alias("all")))
    for c in ("relative", "engagement", "comments"):
        places = evaluation.ordered(places, ["all"], c, "id", f"p_{c}")
    pct = lambda c: (F.col(f"p_{c}") - 1) / F.greatest(F.col(f"p_{c}_n") - 1, F.lit(1)) * 100.0
    value = places.select("id", S.settled(S.weighted_renormalised((0.55, pct("relative")), (0.25, pct("engagement")), (0.15, pct("comments")))).alias("value"))
    rows = stage(_split(rows.join(value.hint("merge"), "id"), 0.2))
    features = [f for f in FEATURES if f not in ("likes_delta", "comments_delta")]
    predicted, _ = modeling.suite(rows, features, DRIVER_TARGETS, ["alpha", "views_delta", "decision"], trees=40, depth=8, min_leaf=2)
    return modeling.leaderboard(predicted, DRIVER_TARGETS, BASELINES)


@register()
def predictions(spark, sf):
    """The forest's scores of the last quarter, ranked over all its rows."""
    rows = stage(_split(_rows(spark, sf), 0.25))
    m = modeling.fitted(rows.where("train").select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES], F.col("is_top").cast("double").alias("is_top")), FEATURES, "is_top", "classification", "random_forest", trees=40)
    valid = rows.where("not train").select("id", "entity_id", "run", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])
    p = stage(m.transform(valid).select("id", "entity_id", "run", modeling.score(m, valid, "classification").alias("score")))
    return ranking.ordinal_rank(p, "score", "id", "rank").select("entity_id", "run", "score", "rank")


@register()
def feature_importance(spark, sf):
    """Of the forest for the highest growth: impurity, and how far accuracy falls when a feature is dealt anew (3 times)."""
    rows = stage(_split(_rows(spark, sf), 0.25).select("id", "train", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES], F.col("is_top").cast("double").alias("is_top")))
    m = modeling.fitted(rows.where("train"), FEATURES, "is_top", "classification", "random_forest", trees=40)
    falls = evaluation.permutation_importance(rows.where("not train"), "id", FEATURES, "is_top", m.transform, "accuracy")
    impurity = spark.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, m.stages[-1].featureImportances.toArray())], "feature string, importance double")
    return impurity.join(falls, "feature")


@register()
def tree_rules(spark, sf):
    """The shallow tree for the highest growth as conditions, with the training rows that meet each."""
    rows = stage(_split(_rows(spark, sf), 0.25).where("train").select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES], F.col("is_top").cast("double").alias("is_top")))
    return modeling.tree_rules(modeling.fitted(rows, FEATURES, "is_top", "classification", "shallow_tree"), FEATURES, rows)


_LONG = {"balance": "c_acctbal", "nation": "cast(c_nationkey as double)", "spent": "spent", "orders": "cast(n as double)", "middle": "cast(abs(c_custkey % 100 - 50) as double)"}
_CUSTOMERS = """f as (select c_custkey as id, c_acctbal, c_nationkey, c_custkey, coalesce(sum(o_totalprice), 0) as spent, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1, 2, 3, 4),
p as (select *, round(1 / (1 + exp(-(c_acctbal - 4500) / 4000e0)) / 2 + (c_custkey % 100) / 400e0, 6) as prediction from f)"""


def _customers(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n"))
    c = table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    f = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.coalesce("spent", F.lit(0.0)).alias("spent"), F.coalesce("n", F.lit(0)).cast("double").alias("orders"), F.abs(F.col("c_custkey") % 100 - 50).cast("double").alias("middle"))
    return f.withColumn("prediction", S.barrier(1 / (1 + F.exp(-(F.col("balance") - 4500) / 4000.0)) / 2 + F.col("id") % 100 / 400.0))


@register(f"""with {_CUSTOMERS}, l as ({" union all ".join(f"select '{k}' as feature, id, {x} as value, prediction from p" for k, x in _LONG.items())}),
r as (select *, row_number() over (partition by feature order by value, id) as place, count(*) over (partition by feature) as n from l where value is not null),
b as (select feature, avg(case when place <= greatest(n // 4, 1) then prediction end) as lo, avg(case when place > n - greatest(n // 4, 1) then prediction end) as hi, avg(case when place > greatest(n // 4, 1) and place <= n - greatest(n // 4, 1) then prediction end) as mid from r group by 1)
select feature, case when (lo < mid and mid > hi) or (lo > mid and mid < hi) then 'mixed' when hi - lo > 0.02 then 'positive' when hi - lo < -0.02 then 'negative' else 'flat' end as direction, round(hi - lo, 6) as direction_score, round(lo, 6) as low_mean, round(hi, 6) as high_mean from b""")
def feature_directions(spark, sf):
    """How a score of customers moves from the lowest to the highest quarter of five features, in one pass."""
    f = _customers(spark, sf)
    return evaluation.directions(f.unpivot(["id", "prediction"], list(_LONG), "feature", "value"), ["feature"], "value", "prediction", "id")


@register(f"""with {_CUSTOMERS}, l as (select feature, repeat, id, value from ({" union all ".join(f"select '{k}' as feature, id, {_LONG[k]} as value from p" for k in ("balance", "orders"))}), (select unnest([1, 2, 3]) as repeat)),
a as (select feature, repeat, value, row_number() over (partition by feature, repeat order by md5('42|' || feature || '|' || repeat || '|' || id), id) as place from l),
b as (select id, row_number() over (order by id) as place from f)
select feature, repeat::integer as repeat, id, value from a join b using (place)""")
def permuted_features(spark, sf):
    """Two features of all customers dealt anew, three times each."""
    return evaluation.permuted(_customers(spark, sf), "id", ["balance", "orders"])
