"""Quality scores by positive-unlabelled learning (operator 4).

Trusted positives are texts labelled 1; every other training text counts as unlabelled, whatever its label. A linear
model over shares of character classes, word statistics and hashed byte trigrams minimises the non-negative
unbiased risk; the class prior comes from the score tails of a first model. The sample it is fitted on is bounded: up
to twice ``positives`` and ``unlabelled`` distinct texts, drawn by hash of the text. Features are taken where the rows
lie, and only those of the drawn texts (some 600 bytes each) meet in one task. Every whole text is scored.

Null and empty texts have all features 0 but the constant and get that score. Repeated rows and ties score alike; rows
without id, or with one that others have too, are drawn and scored like all others, but no positive lacks an id. Very
long texts are blocks of their own. Extra columns pass through, but for the score's, which is replaced. An empty table
gives no rows. Without positives in training every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm import kernel

TRIGRAMS = 128
_CLASSES = np.zeros((256, 14), np.float64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\r", "!", ".,;:", "|", "#$%&*", "@/\\_=+~^", "\"'()[]{}<>", "-", "?")):
    _CLASSES[[ord(c) for c in _chars], _k] = 1
_CLASSES[0x80:, 13] = 1
WIDTH = _CLASSES.shape[1] + 6 + TRIGRAMS


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows x WIDTH features), block by block."""
    for row, _, data, offsets in kernel.blocks(texts, 256 << 10, 1024):
        rows = len(offsets) - 1
        of = np.repeat(np.arange(rows), np.diff(offsets))
        size = np.maximum(np.diff(offsets), 1)[:, None]
        per_byte = np.bincount(of * 256 + data, minlength=rows * 256).reshape(rows, 256)
        starts, ends, h, by_row = kernel.words(data, offsets)
        n = np.maximum(np.diff(by_row), 1)
        word_of = np.repeat(np.arange(rows), np.diff(by_row))
        distinct = np.bincount(word_of[_first_of(word_of, h)], minlength=rows)
        pair_h, pair_at = kernel.ngrams(h, by_row, 3)
        pair_of = word_of[pair_at]
        pairs = np.bincount(pair_of, minlength=rows)
        distinct_pairs = np.bincount(pair_of[_first_of(pair_of, pair_h)], minlength=rows)
        length = (ends - starts).astype(float)
        mean = np.bincount(word_of, length, minlength=rows) / n
        long_words = np.bincount(word_of, length > 12, minlength=rows) / n
        stats = np.stack([distinct / n, distinct_pairs / np.maximum(pairs, 1), mean / 10, long_words, np.log1p(size[:, 0]) / 10, np.log1p(n) / 10], 1)
        grams = np.sqrt(kernel.hashed_bytes(data, offsets, 3, TRIGRAMS) / size)
        yield row, np.hstack([np.sqrt(per_byte @ _CLASSES / size), stats, grams]).astype(np.float32)


def _first_of(of: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    return order[new]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nn_pu(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) by Adam on the non-negative unbiased risk with the logistic loss."""
    p, u = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = (u * _sigmoid(zu)[:, None]).mean(0) - prior * (p * _sigmoid(zp)[:, None]).mean(0)
        if negative < 0:  # the estimate of a risk can't be negative: undo what made it so
            g = -g
        else:
            g = g - prior * (p * _sigmoid(-zp)[:, None]).mean(0)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Least ratio of unlabelled to positive texts above a score, over scores that at least a fifth of the positives reach."""
    cuts = np.quantile(p, np.linspace(0.02, 0.8, 40))
    ratio = [(u >= c).mean() / max((p >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def fit(train: DataFrame, positive_ids: DataFrame, positives: int = 3000, unlabelled: int = 6000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features and the weights. ``train``: doc_id, text; ``positive_ids``: doc_id."""
    kernel.small_batches(train.sparkSession)
    train = train.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    hashed = lambda salt, *c: F.pmod(F.xxhash64(*c, F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    n_positive, n_all = positive_ids.count(), train.agg(F.approx_count_distinct("k1").alias("n")).first().n
    # at most 2 * positives ids, so that they may be broadcast
    some = positive_ids.where(hashed(1, "doc_id") < positives / max(n_positive, 1)).select("doc_id", F.lit(1).alias("p")).distinct().limit(2 * positives)
    drawn = train.join(F.broadcast(some), "doc_id", "left").withColumn("u", hashed(2, "k1", "k2") < unlabelled / max(n_all, 1)).where("p = 1 or u")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in features(batch.column(0)):
                part = batch.slice(row, len(x))
                ends = pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["k1", "k2", "p", "u", "x"])

    rows = drawn.select("text", "k1", "k2", F.coalesce("p", F.lit(0)).alias("p"), "u").mapInArrow(extract, "k1 long, k2 long, p int, u boolean, x array<float>")
    rows = kernel.stored(rows.groupBy("k1", "k2").agg(F.max("p").alias("p"), F.max("u").alias("u"), F.first("x").alias("x")))
    # an id may have any number of texts: as many of either kind as are bounded above
    few = lambda where, n: rows.where(where).orderBy(F.xxhash64("k1", F.lit(3)), "k1", "k2").limit(n)
    sample = few("p = 1", 2 * positives).withColumn("u", F.lit(False)).unionByName(few("u", 2 * unlabelled).withColumn("p", F.lit(0)))

    def train_one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2", "p"], kind="stable")
        x = np.stack(pdf["x"].to_numpy()).astype(np.float64)
        p, u = x[pdf["p"].to_numpy() == 1], x[pdf["u"].to_numpy()]
        mean, scale, w = x.mean(0), x.std(0) + 1e-3, np.zeros(WIDTH + 1)
        if len(p) and len(u):
            p, u = (p - mean) / scale, (u - mean) / scale
            # the prior comes from the halves that the first model has not seen
            first = fit_nn_pu(p[::2], u[::2], 0.5, 150)
            seen = lambda x: x[1::2] @ first[:-1] if len(x) > 1 else x @ first[:-1]
            w = fit_nn_pu(p, u, estimated_prior(seen(p), seen(u)))
        return pd.DataFrame({"model": [np.concatenate([mean, scale, w]).tolist()]})

    model = sample.groupBy(F.lit("all")).applyInPandas(train_one, "model array<double>").collect()
    flat = np.array(model[0].model) if model else np.concatenate([np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1)])
    return flat[:WIDTH], flat[WIDTH : 2 * WIDTH], flat[2 * WIDTH :]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], name: str = "score") -> DataFrame:
    """Adds the score to all columns of ``docs``."""
    names = [c for c in docs.columns if c != name]
    kernel.small_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale, w = kept.value
        for batch in batches:
            out = np.full(len(batch), float(_sigmoid(w[-1])))
            for row, x in features(batch.column(batch.schema.get_field_index("text"))):
                out[row : row + len(x)] = _sigmoid(((x - mean) / scale) @ w[:-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(names).dtypes) + f", `{name}` double"
    return docs.select(names).mapInArrow(scored, schema)
