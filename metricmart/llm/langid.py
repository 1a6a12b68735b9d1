"""Language identification by nearest centroid (operator 3).

A text is a TF-IDF vector of hashed letter bigrams and trigrams of its UTF-8 bytes, of length one. Each language
has several centroids (spherical k-means over a bounded, documented sample of its labelled rows); a text gets the
language of the nearest by cosine, and is marked rejected if even that one is farther than half the least cosine
seen in training (less for texts of few n-grams). Document frequencies come from
all labelled training rows.

Null texts and texts without a letter are ``und``, score 0 and rejected. Rows are independent, so repeats and
ties behave alike (ties: the first language in alphabetical order); null ids matter nothing. In training, copies of a
text count once in the sample, and rows without text or language are left out; every language that has a row is
learned. Texts are read whole, whatever their length. Extra columns pass through, but for lang_pred, score and
rejected, which are replaced. Without labelled rows everything is ``und``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm import kernel

DIMS = ((2, 1024), (3, 4096))
WIDTH = sum(d for _, d in DIMS)
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)


def letter_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x WIDTH counts), block by block."""
    for row, _, data, offsets in kernel.blocks(texts, 256 << 10, 512):
        codes = _LETTERS[data]
        yield row, np.hstack([kernel.hashed_bytes(codes, offsets, n, dim) for n, dim in DIMS])


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one row each
    least: np.ndarray  # cosine below which a text is rejected, by centroid
    idf: np.ndarray


def _document_frequencies(train: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for _, x in letter_counts(batch.column(0)):
                df += (x > 0).sum(0)
                n += len(x)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*df[at], n], pa.int64())], names=["bucket", "df"])

    rows = train.select("text").mapInArrow(count, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # WIDTH + 1 at most
    out = np.zeros(WIDTH + 1)
    for r in rows:
        out[r.bucket] = r.df
    return np.log((1 + out[-1]) / (1 + out[:-1])) + 1


def fit(labelled: DataFrame, clusters: int = 4, per_language: int = 400, rounds: int = 12) -> LanguageModel:
    """``labelled``: text, lang. ``per_language``: distinct texts sampled of each language (by hash) for its centroids."""
    kernel.small_batches(labelled.sparkSession)
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    idf = _document_frequencies(rows)
    draw = F.xxhash64("text")
    counts = rows.select("lang", draw.alias("h")).distinct().groupBy("lang").count().collect()  # copies count once; one row a language, as the model has
    if not counts:
        return LanguageModel([], np.zeros((0, WIDTH)), np.zeros(0), idf)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, per_language / r["count"]))])
    picked = rows.where(F.pmod(draw, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).groupBy("lang", draw.alias("h")).agg(F.min("text").alias("text")).select("lang", "text")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text").drop_duplicates("text").head(2 * per_language)
        x = np.vstack([np.log1p(c) * idf for _, c in letter_counts(pa.array(pdf["text"], pa.string()))]).astype(np.float32)
        x = unit_rows(x)
        k = min(clusters, len(x))
        chosen = [int((x @ x.mean(0)).argmax())]
        while len(chosen) < k:  # farthest first
            chosen.append(int((x @ x[chosen].T).max(1).argmin()))
        c = x[chosen]
        for _ in range(rounds):
            near = (x @ c.T).argmax(1)
            c = unit_rows(np.vstack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)]))
        best = x @ c.T
        near = best.argmax(1)
        least = [0.5 * np.quantile(best[near == j, j], 0.001) if (near == j).any() else 0.0 for j in range(k)]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "cluster": range(k), "centroid": list(c.astype(np.float32)), "least": least})

    found = picked.groupBy("lang").applyInPandas(centre, "lang string, cluster int, centroid array<float>, least double").toPandas()
    if found.empty:
        return LanguageModel([], np.zeros((0, WIDTH)), np.zeros(0), idf)
    found = found.sort_values(["lang", "cluster"])
    return LanguageModel(found["lang"].tolist(), np.array(found["centroid"].tolist(), np.float32).reshape(len(found), WIDTH), found["least"].to_numpy(float), idf)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score (cosine to the nearest centroid) and rejected to all columns of ``docs``."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    kernel.small_batches(docs.sparkSession)
    languages = np.array([*model.languages, "und"], object)
    kept = docs.sparkSession.sparkContext.broadcast((model.centroids.T.astype(np.float32), model.least, model.idf.astype(np.float32)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, least, idf = kept.value
        for batch in batches:
            at, score, rejected = np.full(len(batch), len(least)), np.zeros(len(batch)), np.ones(len(batch), bool)
            letter = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            for row, x in letter_counts(batch.column(batch.schema.get_field_index("text"))) if len(least) else ():
                cosine = unit_rows(np.log1p(x) * idf) @ centroids
                best = cosine.argmax(1)
                value = cosine[np.arange(len(x)), best]
                own = slice(row, row + len(x))
                at[own] = np.where(letter[own], best, len(least))
                score[own] = np.where(letter[own], np.clip(value, 0, 1), 0)
                sure = np.sqrt(np.minimum(x.sum(1) / 400, 1))  # a short text has few n-grams to share
                rejected[own] = ~letter[own] | (value < least[best] * sure)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages[at], pa.string()), pa.array(score), pa.array(rejected)], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(names).dtypes) + ", lang_pred string, score double, rejected boolean"
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*names, has_letter.alias(kernel.fresh(docs, "_has_letter"))).mapInArrow(nearest, schema)
