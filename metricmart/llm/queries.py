"""One query for each operator of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.llm import ann, chat, decontam, filteraudit, hardneg, jaccard, langid, packing, pii, quality, secrets, tokencount, toxicity
from metricmart.llm.folds import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(tricky).alias("text")) for k, role in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    messages = said.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    return chat.digest(chat.format_chats(messages))


def _sql_escaped(x: str) -> str:
    out = f"replace(coalesce({x}, ''), '\\', '\\\\')"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP1_SQL = f"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
ordered as (select *, {_sql_escaped("role")} as r, {_sql_escaped("text")} as t from said)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, t)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, t) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(r) + length(t) + {len(chat.START + chat.SEP + chat.END)}) as bigint) as formatted_chars
from ordered group by conv_id
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(4, 2)))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where(~held_out(3, 1) & (F.col("quality") == 1)).select("doc_id").distinct()
    out = quality.score(docs, quality.fit(docs.where(~held_out(3, 1)), trusted))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return ann.nearest(vectors, vectors.where("id % 100 = 0"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    letters = toxicity.character_model(docs)
    out = toxicity.score(docs, letters, toxicity.fit(docs.where(~held_out(4, 2)), labels, letters))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY, None) or "key of the synthetic tables"  # these hold no one's data, and runs are to agree
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return hardneg.mine(rows, F.col("id") % 50 == 0)


OP12_SQL = """
with q as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.id as anchor_id, b.id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from q a join q b on a.id % 50 = 0 and a.id <> b.id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id) as integer) as rank,
  n.id as negative_id, p.positive_score, n.score as negative_score
from positives p join pairs n on n.anchor_id = p.anchor_id and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify rank <= 3
"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
words as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as least from texts),
fails as (
  select doc_id, part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d, coalesce(least < doc_id, false) as e from words),
marks as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by 1),
sets as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as bits, count(*) as n,
    count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from fails left join marks using (doc_id) group by 1, 2),
letter as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(f, bit)),
orders as (
  select v.f || w.f || x.f || y.f || z.f as filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] as bits
  from letter v, letter w, letter x, letter y, letter z where v.bit | w.bit | x.bit | y.bit | z.bit = 31),
steps as (
  select filter_order, s as step, bits[s] as bit, list_sum(bits[1:s]) - bits[s] as earlier from orders, (select unnest(range(1, 6)) as s)),
audit as (
  select part, filter_order, cast(step as integer) as step, bit,
    sum(case when sets.bits & (bit | earlier::bigint) = 0 then n else 0 end) as kept,
    sum(case when sets.bits & bit > 0 and sets.bits & earlier::bigint = 0 then n else 0 end) as removed,
    sum(case when sets.bits & bit > 0 and sets.bits & earlier::bigint > 0 then n else 0 end) as redundant,
    sum(case when sets.bits = bit then n else 0 end) as unique_fails,
    sum(case when sets.bits & bit > 0 and sets.bits & earlier::bigint = 0 then good else 0 end) as good_lost,
    sum(case when sets.bits & bit > 0 and sets.bits & earlier::bigint = 0 then toxic else 0 end) as toxic_lost
  from sets, steps group by 1, 2, 3, 4)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, sum(removed) over (partition by part, bit)::bigint as shapley
from audit
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_format, op2_best_fit_packing, op3_language_id, op4_quality_classifier, op5_decontamination, op6_nearest_neighbours, op7_toxicity, op8_pii_surrogates, op9_jaccard_join, op10_token_counts, op11_secret_scan, op12_hard_negatives, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op12_hard_negatives": OP12_SQL, "op13_filter_audit": OP13_SQL}
