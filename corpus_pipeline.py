"""A corpus cleaned in stages: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last keep the columns of ``documents``. Rows are told apart by their id and text, so
documents without an id, or with one that others have too, are judged like all others. ``docs`` may hold any further
columns. An empty table passes every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricmart.llm import decontam, jaccard, langid, packing, pii
from metricmart.llm.kernel import dropped, fresh, small_batches, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised (operator 3)."""
    small_batches(spark)
    out = langid.predict(docs, langid.fit(docs))
    return out.where(~F.col("rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (operator 9); equal rows stay once."""
    first = jaccard.first_of_each_group(docs)
    id_, key1, key2 = (fresh(docs, x) for x in ("_id", "_key1", "_key2"))
    one, two = jaccard.text_keys(F.col("text"))
    marked = docs.withColumns({id_: F.col("doc_id").cast("long"), key1: one, key2: two})
    first = first.toDF("f_id", "f_key1", "f_key2").select(F.col("f_id").alias(f"f{id_}"), F.col("f_key1").alias(f"f{key1}"), F.col("f_key2").alias(f"f{key2}"))
    same = F.col(id_).eqNullSafe(F.col(f"f{id_}")) & (F.col(key1) == F.col(f"f{key1}")) & (F.col(key2) == F.col(f"f{key2}"))
    kept = marked.join(first, same, "left_semi")
    # a row of the same id and text may differ elsewhere: the smallest of its other columns stays
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.sha2(F.to_json(F.struct(*[F.col(c) for c in others])), 256) if others else F.lit("")
    rank = fresh(docs, "_rank")
    twice = stored(marked.groupBy(id_, key1, key2).count().where("count > 1").select(*[F.col(c).alias(f"t{c}") for c in (id_, key1, key2)]))
    again = F.col(id_).eqNullSafe(F.col(f"t{id_}")) & (F.col(key1) == F.col(f"t{key1}")) & (F.col(key2) == F.col(f"t{key2}"))
    if twice.isEmpty():
        return kept.select(docs.columns)
    whole = F.struct(order.alias(rank), *[F.col(c) for c in docs.columns])
    several = kept.join(twice, again, "left_semi").groupBy(id_, key1, key2).agg(F.min(whole).alias("w")).select("w.*").select(docs.columns)
    return kept.join(twice, again, "left_anti").select(docs.columns).unionByName(several)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item is found (operator 5)."""
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data (operator 8); n_chars follows the new text."""
    out = pii.replace_entities(docs)
    if "n_chars" not in docs.columns:
        return out.select(docs.columns)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences (operator 2)."""
    small_batches(spark)
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", replace_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the learned stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)  # a stage's input goes once its output stands
        before = docs
    return docs
