"""Hard-negative mining by blocked dense products (operator 12).

Vectors are quantised to whole numbers, floor(``scale`` x), and compared by inner product. Anchors go out in blocks of
at most about ``block_bytes`` by broadcast; the candidates stay where they lie and meet each block in Arrow batches, as
one float64 matrix product a label. Whole numbers below 2^53 are exact there; where a product could pass that, the batch
is multiplied in whole numbers instead (64 bits, or Python's beyond them; a score past the range of a long is its end).

Two passes for each block of anchors:

1. every task keeps each anchor's ``positives`` best rows of its label over all its batches; tasks' lists are merged;
2. every task keeps, for each anchor and positive, the ``negatives`` best rows of other labels whose score lies from
   ``low`` to ``high`` (fractions) times the positive's; again the lists are merged.

A task sends at most positives (x negatives) rows an anchor, and there are at most ``tasks`` a core, however many files
the table has. The work is anchors x rows by nature; neither is collected whole.

Rows without an id or label, or with a null vector or a null or non-finite component, take no part. Of rows that share
an id the one with the smallest label and vector counts. Vectors meet those of their own dimension. Higher scores come
first, ties by smaller id, so results don't depend on the order of rows; repeated vectors under other ids are rows like
all others. An anchor without another row of its label has no result, a positive without a negative in its window
neither (so none has with a negative score). Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.llm.kernel import stored

EXACT = 1 << 53
#: Scores that a task holds at once, whatever the size of a block.
CELLS = 1 << 21
LONG = np.iinfo(np.int64)
_LEAST = LONG.min


def usable(vector: Column) -> Column:
    """Not null, and all components known and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as float64 where that is exact, else as Python's whole numbers."""
    with np.errstate(over="ignore"):
        q = np.floor(scale * x)
    if np.isfinite(q).all():
        return q
    wide = [[int(v) if np.isfinite(v) else scale * int(u) for v, u in zip(a, b)] for a, b in zip(q.tolist(), x.tolist())]
    return np.array(wide, object)  # so large a double is whole


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b`` (whole numbers) as longs."""
    most = lambda x: max((abs(int(v)) for v in (x.max(), x.min())), default=0) if x.size else 0
    bound = most(a) * most(b) * max(a.shape[1], 1)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape)
    if bound < 1 << 63:
        return whole(a).astype(np.int64) @ whole(b).astype(np.int64).T
    return np.clip(whole(a) @ whole(b).T, LONG.min, LONG.max).astype(np.int64)


def times(score: np.ndarray, num: int, den: int, up: bool) -> np.ndarray:
    """score num / den rounded down or up, without passing the range of longs (0 <= num <= den)."""
    whole, rest = np.divmod(score, den)
    return whole * num + (-((-rest * num) // den) if up else rest * num // den)


class Best:
    """The first ``k`` (score, id) of each of ``n`` lists: higher scores first, then smaller ids. Lists merge."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), _LEAST), np.full((n, k), LONG.max)
        self.full = np.zeros(n, np.int64)

    def add(self, lists: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        """Entries (list, score, id) in any order."""
        if not len(lists):
            return
        hit = np.unique(lists)
        slot = np.arange(self.k)[None, :] < self.full[hit][:, None]
        old = np.broadcast_to(hit[:, None], slot.shape)[slot]
        lists = np.concatenate([old, lists])
        score, id_ = np.concatenate([self.score[hit][slot], score]), np.concatenate([self.id[hit][slot], id_])
        order = np.lexsort((id_, ~score, lists))  # ~s falls as s rises, over the whole range
        lists, score, id_ = lists[order], score[order], id_[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        self.score[lists[keep], place[keep]], self.id[lists[keep], place[keep]] = score[keep], id_[keep]
        np.maximum.at(self.full, lists[keep], place[keep] + 1)

    def least(self, rows: np.ndarray | slice) -> np.ndarray:
        """The score below which nothing can enter a list."""
        return np.where(self.full[rows] == self.k, self.score[rows, -1], _LEAST)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(np.arange(self.k)[None, :] < self.full[:, None])
        return at, self.score[at, place], self.id[at, place]


class Block:
    """A block of anchors of one dimension: ids, labels and quantised vectors, in the order of their labels."""

    def __init__(self, pdf: pd.DataFrame, scale: int):
        pdf = pdf.sort_values(["label", "id"], ignore_index=True)
        self.id, self.label = pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        self.q = quantised(np.stack([np.asarray(v, np.float64) for v in pdf["v"]]), scale)

    def of(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))


def _candidates(batch: pa.RecordBatch, anchors: dict[int, int], scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, labels, quantised vectors) of a batch's rows. ``anchors``: how many there are of each dimension."""
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    for d in sorted(anchors.keys() & set(np.unique(sizes).tolist())):
        at, most = np.flatnonzero(sizes == d), max(1, CELLS // anchors[d])
        for lo in range(0, len(at), most):
            part = at[lo : lo + most]
            x = batch.column(2).take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)
            yield d, ids[part], labels[part], quantised(np.asarray(x, np.float64), scale)


def _positives(blocks, scale: int, k: int):
    """mapInArrow function: the best rows of each anchor's label in a task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, anchors = {d: Best(len(b.id), k) for d, b in blocks.value.items()}, {d: len(b.id) for d, b in blocks.value.items()}
        for batch in batches:
            for d, ids, labels, q in _candidates(batch, anchors, scale):
                block, state = blocks.value[d], found[d]
                for label in np.unique(labels).tolist():
                    rows, same = block.of(label), np.flatnonzero(labels == label)
                    if rows.start == rows.stop:
                        continue
                    s = products(block.q[rows], q[same])
                    a, c = np.nonzero((s >= state.least(rows)[:, None]) & (block.id[rows][:, None] != ids[same][None, :]))
                    state.add(a + rows.start, s[a, c], ids[same][c])
        for d, state in found.items():
            at, score, id_ = state.rows()
            yield pa.RecordBatch.from_arrays([pa.array(blocks.value[d].id[at]), pa.array(id_), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    return best


def _negatives(blocks, scale: int, k: int):
    """mapInArrow function: the best rows of other labels in each window of a task. Blocks come with their windows:
    arrays (anchor's index, positive's id, its score, least and greatest score) in the order of the anchors."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, anchors = {d: Best(len(w[0]), k) for d, (_, w) in blocks.value.items()}, {d: len(b.id) for d, (b, _) in blocks.value.items()}
        for batch in batches:
            for d, ids, labels, q in _candidates(batch, anchors, scale):
                (block, (of, _, _, low, high)), state = blocks.value[d], found[d]
                s = products(block.q, q)
                # an anchor's windows: nothing above the highest or below the lowest matters
                other = block.label[:, None] != labels[None, :]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
                top, bottom = np.full(len(block.id), _LEAST), np.full(len(block.id), LONG.max)
                if len(of):
                    top[of[first]] = np.maximum.reduceat(high, first)
                    bottom[of[first]] = np.minimum.reduceat(np.maximum(low, state.least(slice(None))), first)
                a, c = np.nonzero(other & (s <= top[:, None]) & (s >= bottom[:, None]))
                if not len(a):
                    continue
                score, id_ = s[a, c], ids[c]
                windows, begin = np.diff(np.append(first, len(of))), np.zeros(len(block.id), np.int64)
                count = np.zeros(len(block.id), np.int64)
                begin[of[first]], count[of[first]] = first, windows
                for j in range(int(windows.max())):
                    have = np.flatnonzero(count[a] > j)
                    w = begin[a[have]] + j
                    ok = (score[have] <= high[w]) & (score[have] >= np.maximum(low, state.least(slice(None)))[w])
                    state.add(w[ok], score[have][ok], id_[have][ok])
        for d, state in found.items():
            block, (of, positive, positive_score, _, _) = blocks.value[d]
            at, score, id_ = state.rows()
            yield pa.RecordBatch.from_arrays([pa.array(block.id[of[at]]), pa.array(positive[at]), pa.array(positive_score[at]), pa.array(id_), pa.array(score)], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return best


def _first(df: DataFrame, by: list[str], score: str, id_: str, k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), id_)
    return df.withColumn(rank, F.row_number().over(order).cast("int")).where(F.col(rank) <= k)


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, v), of a repeated id the smallest; rows of ids that are not repeated are not shuffled."""
    twice = stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if twice.isEmpty():
        return rows
    least = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    return rows.join(twice, "id", "left_anti").unionByName(least)


def mine(rows: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), block_bytes: int = 16 << 20, tasks: int = 4) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id long, label long, v array<double>; ``anchors``: which of them are anchors, of their id or label.
    ``low`` and ``high``: fractions (from 0 to 1) as numerator and denominator. ``tasks``: at most so many a core.
    """
    spark = rows.sparkSession
    rows = rows.where("id is not null and label is not null").where(usable(F.col("v"))).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v"))
    rows = stored(one_row_an_id(rows))
    chosen = rows.where(anchors)
    size = chosen.agg(F.count("*").alias("n"), F.sum(8 * F.size("v") + 16 * (1 + positives)).alias("bytes")).first()
    parts = max(1, -(-(size["bytes"] or 0) // block_bytes))
    chosen = chosen.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    if parts > 1:
        chosen = stored(chosen.repartition("block"))
    few = rows.coalesce(max(1, tasks * spark.sparkContext.defaultParallelism))  # fewer lists to merge
    out = []
    for part in range(parts):
        pdf = chosen.where(F.col("block") == part).drop("block").toPandas()  # about block_bytes
        if not len(pdf):
            continue
        blocks = {int(d): Block(p, scale) for d, p in pdf.groupby(pdf["v"].map(len))}
        sent = spark.sparkContext.broadcast(blocks)
        best = few.mapInArrow(_positives(sent, scale, positives), "anchor_id long, positive_id long, positive_score long")
        best = _first(best, ["anchor_id"], "positive_score", "positive_id", positives, "at").toPandas().sort_values(["anchor_id", "at"])  # positives rows an anchor of the block
        windows = {}
        for d, block in blocks.items():
            where = pd.Series(np.arange(len(block.id)), block.id)
            own = best[best["anchor_id"].isin(where.index)]
            of, score = where.loc[own["anchor_id"]].to_numpy(), own["positive_score"].to_numpy(np.int64)
            order = np.argsort(of, kind="stable")
            of, score, pos = of[order], score[order], own["positive_id"].to_numpy(np.int64)[order]
            windows[d] = (block, (of, pos, score, times(score, *low, up=True), times(score, *high, up=False)))
        asked = spark.sparkContext.broadcast(windows)
        found = few.mapInArrow(_negatives(asked, scale, negatives), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        out.append(stored(_first(found, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", negatives, "rank")))
        sent.destroy()
        asked.destroy()
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return reduce(DataFrame.unionByName, out).select(columns)
