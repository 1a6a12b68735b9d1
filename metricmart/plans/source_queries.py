"""Tables written by the sinks, read back by the sources, and compared with the rows they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricmart.plans.bindings import table
from metricmart.plans.registry import register
from metricmart.session import folder
from metricmart.sources import catalog, files, publish, runs


@register("select cast(c_custkey as varchar) as c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, null::varchar as absent from customer")
def csv_round_trip(spark, sf):
    at, columns = folder(spark), ["c_custkey", "c_name", "c_mktsegment", "absent"]
    files.write_csv(table(spark, sf, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING"))), at, columns)
    return files.read_csv(spark, at, columns)


def _jsonl(spark, sf, compressed: bool) -> DataFrame:
    at = folder(spark)
    files.write_jsonl(table(spark, sf, "events").select("event_id", "user_id", "event_type", "props"), at, compressed)
    return files.read_jsonl(spark, at, "event_id long, user_id long, event_type string, props string")


@register("select event_id, user_id, event_type, props from events")
def jsonl_round_trip(spark, sf):
    return _jsonl(spark, sf, False)


@register("select event_id, user_id, event_type, props from events")
def jsonl_gz_round_trip(spark, sf):
    return _jsonl(spark, sf, True)


@register("select 0 as rows where false")
def missing_files(spark, sf):
    at = folder(spark)
    none = [files.read_csv(spark, at, ["a"]).select("a"), files.read_jsonl(spark, at, "a string"), files.read_json_documents(spark, at, "a string").select("a")]
    return none[0].union(none[1]).union(none[2]).select(F.lit(0).alias("rows"))


@register("select case when event_id % 7 = 0 then null else json_extract_string(props, '$.k') end as k, event_id % 7 <> 0 as valid from events")
def json_documents(spark, sf):
    """A document for each event, every seventh broken."""
    at = folder(spark)
    some = table(spark, sf, "events")
    some.select(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k")))).alias("value")).repartition(4, "value").write.text(at)
    lines = spark.read.text(at)  # one document a line here
    parsed = F.from_json("value", "k string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("d")).select("d.k", F.col("d._bad").isNull().alias("valid"))


_QUARTER = "date_trunc('quarter', o_orderdate)"
_RUNS = f"r as (select o_orderkey, strftime({_QUARTER}, '%Y-%m-%d') as dt, '093000Z' as run, cast({_QUARTER} as timestamp) + interval 9 hours + interval 30 minutes as run_key from orders)"


def _runs(spark, sf) -> DataFrame:
    at = folder(spark)
    o = table(spark, sf, "orders").select("o_orderkey", (F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")) + F.expr("interval 9 hours 30 minutes")).alias("_at"))
    runs.write_runs(o, at, F.col("_at"))
    return runs.read_runs(spark, at).drop("_at")


@register(f"with {_RUNS} select dt, run, run_key, count(*) as n from r group by 1, 2, 3")
def run_partitions(spark, sf):
    return runs.list_runs(_runs(spark, sf))


@register(f"with {_RUNS} select o_orderkey, dt, run from r where run_key = (select max(run_key) from r)")
def latest_run(spark, sf):
    return runs.latest_run(_runs(spark, sf)).select("o_orderkey", "dt", "run")


@register(f"with {_RUNS} select o_orderkey, dt from r where run_key = (select max(run_key) from r where run_key < timestamp '1997-07-01 09:30:00')")
def latest_partition_before(spark, sf):
    return runs.latest_run_before(_runs(spark, sf), "1997-07-01 09:30:00").select("o_orderkey", "dt")


@register("select run, case when run in ('090501Z', '230501-0400') then make_timestamp(2026, 4, 27, 9, 5, 1.0) + case when run = '090501Z' then interval 0 hours else interval 18 hours end end as instant from (values ('090501Z'), ('230501-0400'), ('9999'), ('250000Z'), ('latest')) t(run)")
def run_names(spark, sf):
    names = spark.createDataFrame([(x,) for x in ("090501Z", "230501-0400", "9999", "250000Z", "latest")], "run string")
    return names.select("run", runs.run_time(F.lit("2026-04-27"), F.col("run")).alias("instant"))


_SNAPSHOT = """s as (select o_orderkey as entity_id, case when o_orderkey % 11 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as execution_date,
 case when o_orderkey % 13 = 0 then null else strftime(o_orderdate - interval 30 days, '%Y-%m-%dT%H:%M:%SZ') end as upload_date, cast(o_totalprice as bigint) as views from orders)"""


def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    at = folder(spark)
    o = table(spark, sf, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = o.select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(iso(F.col("t"))).alias("execution_date"), F.when(F.col("o_orderkey") % 13 != 0, iso(F.col("t") - F.expr("interval 30 days"))).alias("upload_date"), F.round("o_totalprice").cast("long").alias("views"), F.lit(0).cast("long").alias("likes"))
    files.write_jsonl(rows, at, True)
    return runs.typed(files.read_jsonl(spark, at, runs.SNAPSHOT), ["execution_date", "upload_date"])


@register(f"with {_SNAPSHOT} select entity_id, cast(execution_date as timestamp) as execution_date, cast(upload_date as timestamp) as upload_date from (select * from s where execution_date <> 'soon' and upload_date is not null)")
def snapshot_reader(spark, sf):
    return _snapshots(spark, sf)[0].select("entity_id", "execution_date", "upload_date")


@register(f"with {_SNAPSHOT} select entity_id, concat_ws('|', case when execution_date = 'soon' then 'execution_date' end, case when upload_date is null then 'upload_date' end) as reject from s where execution_date = 'soon' or upload_date is null")
def snapshot_rejects(spark, sf):
    return _snapshots(spark, sf)[1].select("entity_id", "reject")


@register("""select c.o_custkey as entity_id, c.n as views, p.n as previous, c.n - p.n as views_delta, p.n is null as is_new from
 (select o_custkey, count(*) as n from orders group by 1) c left join (select o_custkey, count(*) as n from orders where o_orderdate < timestamp '1996-01-01' group by 1) p using (o_custkey)""")
def growth_export(spark, sf):
    """Current and earlier state, exported as CSV in order and read again."""
    o, at = table(spark, sf, "orders"), folder(spark)
    state = lambda df, name: df.groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias(name))
    now, then = state(o, "views"), state(o.where("o_orderdate < timestamp_ntz '1996-01-01'"), "previous")
    deltas = now.join(then, "entity_id").select("entity_id", "previous", (F.col("views") - F.col("previous")).alias("views_delta"))
    columns = ["entity_id", "views", "previous", "views_delta", "is_new"]
    files.write_csv(runs.growth_export(now, deltas), at, columns, strict=True)
    back = files.read_csv(spark, at, columns)
    return back.select(*[F.col(c).cast("long").alias(c) for c in columns[:-1]], F.col("is_new").cast("boolean").alias("is_new"))


@register("select count(*) as rows from orders where false")
def growth_export_aborted(spark, sf):
    now = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.count("*").alias("views"))
    deltas = now.select("entity_id", F.lit(1).alias("previous"), F.lit(1).alias("views_delta"))
    return runs.growth_export(now, deltas, "aborted").agg(F.count("*").alias("rows"))


@register("select event_type as endpoint, cast(sum(case event_type when 'purchase' then 100 when 'search' then 100 else 1 end) as bigint) as units, count(*) as requests from events group by 1")
def quota_meter(spark, sf):
    cost = F.when(F.col("event_type").isin("purchase", "search"), 100).otherwise(1)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("endpoint")).agg(F.sum(cost).alias("units"), F.count("*").alias("requests"))


@register("select event_id, cast(ts as date) as dt from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def first_seen(spark, sf):
    """History files concatenated, then each key's first row: distinct in order."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    halves = e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1"))
    first = halves.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("k = 1")
    return first.select("event_id", F.to_date("ts").alias("dt"))


@register("""with o as (select o_custkey as entity_id, o_orderkey as k, case when o_orderstatus = 'P' then '' else o_orderstatus end as name, o_orderdate < timestamp '1998-01-01' as early from orders),
g as (select entity_id, bool_or(early) as old, bool_or(not early) as again, coalesce(arg_max(name, k) filter (where not early and name <> ''), arg_max(name, k) filter (where early and name <> ''), '') as name from o group by 1),
t as (select entity_id, name, case when old then date '1998-01-01' else date '1998-08-01' end as first_seen, case when again then date '1998-08-01' else date '1998-01-01' end as last_seen from g)
select *, cast(first_seen + interval 183 days as date) as until, first_seen + interval 183 days >= date '1998-08-01' as active from t""")
def tracking_catalog(spark, sf):
    """A stored catalog after two runs, the second of them twice."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("at"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("name"), (F.col("o_orderdate") < F.expr("timestamp_ntz '1998-01-01'")).alias("early"))
    c = catalog.Catalog(spark, folder(spark), ["entity_id"], "entity_id long, name string, first_seen date, last_seen date, until date, active boolean", 16)
    for early, day in ((True, "1998-01-01"), (False, "1998-08-01"), (False, "1998-08-01")):
        c.merge(o.where(F.col("early") == early), catalog.tracking_rule("entity_id", ["name"], F.lit(day).cast("date")), everywhere=True)
    return c.read()


@register("""with o as (select o_custkey, arg_max(struct_pack(s := o_orderstatus, k := o_orderkey), (o_orderdate, o_orderkey)) as r from orders group by 1) select o_custkey, r.s as status, r.k as o_orderkey from o""")
def stored_registry(spark, sf):
    """A stored registry of each customer's last order, merged year by year in buckets."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", F.col("o_orderstatus").alias("status"), "o_orderkey", "o_orderdate")
    c = catalog.Catalog(spark, folder(spark), ["o_custkey"], "o_custkey long, status string, o_orderkey long, o_orderdate timestamp_ntz", 16)
    cuts = [None, "1996-01-01", "1999-01-01", None]
    for lo, hi in zip(cuts, cuts[1:]):
        rows = o if lo is None else o.where(F.col("o_orderdate") >= F.expr(f"timestamp_ntz '{lo}'"))
        c.merge(rows if hi is None else rows.where(F.col("o_orderdate") < F.expr(f"timestamp_ntz '{hi}'")), catalog.replace_rule(["o_custkey"], ["o_orderdate", "o_orderkey"]))
    return c.read().drop("o_orderdate")


_KIND = "case when trim({c}::varchar) = '' or {c} is null then null when trim({c}::varchar) in ('True', 'False') then 'bool' when regexp_full_match(trim({c}::varchar), '[+-]?[0-9]+') then 'int' when regexp_full_match(trim({c}::varchar), '[+-]?([0-9]+[.][0-9]*|[.][0-9]+)') then 'float' else 'string' end"
_PUBLISHED = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]}


def _types_sql(table: str) -> str:
    each = " union all ".join(f"select {i} as position, '{c}' as name, {_KIND.format(c=c)} as kind from {table}" for i, c in enumerate(_PUBLISHED[table], 1))
    return f"""select '{table}' as table_name, name, position, case when count(kind) = 0 then 'string' when count(distinct kind) = 1 then min(kind) when bool_and(coalesce(kind, 'int') in ('int', 'float')) then 'float' else 'string' end as type,
 count(*) as row_count, count(*) - count(kind) as nulls from ({each}) group by 1, 2, 3"""


@register(" union all ".join(_types_sql(t) for t in _PUBLISHED))
def published_types(spark, sf):
    """Types of all columns of two CSV exports, each inferred in one pass over the whole table."""
    out = []
    for name, columns in _PUBLISHED.items():
        at = folder(spark)
        spark.read.parquet(f"{sf}/{name}.parquet").select(columns).write.option("header", True).csv(at)
        text = spark.read.option("header", True).option("nullValue", "").csv(at)
        out.append(publish.inferred(text).select(F.lit(name).alias("table_name"), "*"))
    return out[0].unionByName(out[1])


@register("select 'customer' as name, count(*) as row_count, round(sum(c_acctbal), 2) as total, sum(c_nationkey) as whole, count(distinct c_mktsegment) as texts from customer")
def published_table(spark, sf):
    """A CSV export published as a typed table and read back by its manifest."""
    at, to = folder(spark), folder(spark)
    spark.read.parquet(f"{sf}/customer.parquet").write.option("header", True).csv(at)
    publish.publish(spark, {"customer": at, "absent": f"{at}-absent"}, to)
    listed = spark.read.json(f"{to}/manifest").where("status = 'published'")
    named = listed.first()
    rows = spark.read.schema(", ".join(f"{c} {publish.SPARK_TYPES[t]}" for c, t in zip(named["columns"], named["types"]))).json(f"{to}/customer")
    sums = rows.agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.sum("c_nationkey").alias("whole"), F.countDistinct("c_mktsegment").alias("texts"))
    return listed.select("name", "row_count").crossJoin(F.broadcast(sums))  # one row each
