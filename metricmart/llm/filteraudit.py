"""Filter interaction audit: what five filters remove in each of their 120 orders (operator 13).

A document's failures are five bits. Of each of the 32 sets of failures and 120 orders a table, made once, holds the
step at which the document goes (its first failing filter), or the place after the last step if it stays. Tasks look
their rows up there and count with ``np.bincount`` by part, order and step, once for all rows and once for each label;
all figures of the audit are sums over documents, so tasks send one array of each figure a part, and these are added.

Filters: A fewer than ``LEAST_WORDS`` words; B distinct words under 80 % of the words (none: passes); C capitals
``[A-Z]`` over 10 % of the code points; D holds one of ``SYMBOLS``; E equals the text of a smaller doc_id. Words are
maximal runs without space, tab, line feed, vertical tab, form feed or carriage return, compared byte for byte.

A to D are computed where the texts lie. For E only keys of texts (128 bits) and ids travel: the least id of each key is
joined to the rows by key and id, so copies of one text spread over all tasks. Rows of one id and text are counted
before the join.

Null texts count as empty, null parts as the empty string. Rows without a doc_id neither fail E nor make others fail,
and have no labels. Rows of a repeated id count each; of several label rows of an id the largest values count. Rows
that share the least id of a text all pass E (ties). Texts are read whole, whatever their length; extra columns are not
read. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm import kernel
from metricmart.llm.jaccard import text_keys

LEAST_WORDS = 100
SYMBOLS = b"#$%&*|"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Filter (0 to 4) of each order and step.
_AT = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: First failing step (0 to 4, 5: none) of each set of failures in each order.
FIRST_FAILURE = np.array([[next((k for k, f in enumerate(order) if fails >> f & 1), STEPS) for order in _AT.tolist()] for fails in range(32)])


def _is(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_CAPITAL, _SYMBOL, _POINT = _is(bytes(range(65, 91))), _is(SYMBOLS), ~_is(bytes(range(0x80, 0xC0)))


def local_failures(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 (filters A to D) of each text."""
    out = np.zeros(len(texts), np.int32)
    for row, end, data, offsets in kernel.blocks(texts):
        count = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])[offsets])  # noqa: E731, B023
        words = [x.split() for x in (data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))]  # bytes split at these six only
        n, distinct = np.array([len(w) for w in words]), np.array([len(set(w)) for w in words])
        fails = [n < LEAST_WORDS, 100 * distinct < 80 * n, 100 * count(_CAPITAL) > 10 * count(_POINT), count(_SYMBOL) > 0]
        out[row:end] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return out


def failures(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, fails (bits of A to E) and n (rows), grouped by these and by text."""
    kernel.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one, two = text_keys(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), one, two, text.alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(local_failures(batch.column(4)))], names=["doc_id", "part", "key1", "key2", "fails"])

    seen = kernel.stored(rows.mapInArrow(look, "doc_id long, part string, key1 long, key2 long, fails int"))
    each = seen.groupBy("doc_id", "part", "key1", "key2", "fails").agg(F.count("*").alias("n"))
    least = seen.where("doc_id is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("least")).select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "least")
    known = each.where("doc_id is not null").join(least, (F.col("doc_id") == F.col("least")) & (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    known = known.select("doc_id", "part", (F.col("fails") + F.when(F.col("least").isNull(), 16).otherwise(0)).alias("fails"), "n")
    return known.unionByName(each.where("doc_id is null").select("doc_id", "part", "fails", "n"))


def part_sums(part: np.ndarray, parts: int, fails: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """parts x figures x orders x steps: the audit of some rows (each standing for ``n`` documents)."""
    at, most = part * 32 + fails, parts * 32
    held = np.stack([np.bincount(at, w, most) for w in (n, n * good, n * toxic)]).astype(np.int64)  # by part and set of failures
    # part-order-step cells of each set of failures; the last step is the place of those that stay
    cell = (np.arange(parts)[:, None, None] * 120 + np.arange(120)) * (STEPS + 1) + FIRST_FAILURE
    gone = np.stack([np.bincount(cell.ravel(), np.repeat(h, 120), parts * 120 * (STEPS + 1)) for h in held]).astype(np.int64).reshape(3, parts, 120, STEPS + 1)
    removed, good_lost, toxic_lost = gone[..., :STEPS]
    kept = gone[0].sum(-1, keepdims=True) - removed.cumsum(-1)
    sets = held[0].reshape(parts, 32)
    failing = np.stack([sets[:, (np.arange(32) >> f & 1).astype(bool)].sum(1) for f in range(STEPS)], 1)[:, _AT]
    unique = sets[:, 1 << np.arange(STEPS)][:, _AT]
    shapley = np.stack([np.where(_AT == f, removed, 0).sum((1, 2)) for f in range(STEPS)], 1)[:, _AT]
    return np.stack([kept, removed, failing - removed, unique, good_lost, toxic_lost, shapley], 1)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", most_parts: int = 256) -> DataFrame:
    """part, filter_order, step and the figures. ``docs``: doc_id, text and the column ``part``; ``labels``: doc_id,
    quality, toxic. ``most_parts``: parts whose sums a task holds before it sends them on."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    rows = failures(docs, part).join(marks, "doc_id", "left").select("part", "fails", "n", mark("good"), mark("toxic"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            figures = [pa.array([x[k].ravel() for x in held.values()], pa.list_(pa.int64())) for k in range(len(FIGURES))]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *figures], names=["part", *FIGURES])

        for batch in batches:
            code = pc.dictionary_encode(batch.column(0))
            of, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            order = np.argsort(of, kind="stable")
            columns = [batch.column(k).to_numpy()[order] for k in range(1, 5)]
            of = of[order]
            for first in range(0, len(names), most_parts):
                some = names[first : first + most_parts]
                at = slice(*np.searchsorted(of, [first, first + len(some)]))
                fails, n, good, toxic = (c[at] for c in columns)
                for name, x in zip(some, part_sums(of[at].astype(np.int64) - first, len(some), fails.astype(np.int64), n, good, toxic)):
                    held[name] = held[name] + x if name in held else x
                if len(held) >= most_parts:
                    yield sums()
                    held.clear()
        if held:
            yield sums()

    partial = rows.mapInArrow(add, "part string, " + ", ".join(f"{f} array<long>" for f in FIGURES))
    cells = partial.select("part", F.posexplode(F.arrays_zip(*FIGURES)).alias("cell", "x"))
    total = cells.groupBy("part", "cell").agg(*[F.sum(f"x.{f}").alias(f) for f in FIGURES])
    order = F.element_at(F.array(*map(F.lit, ORDERS)), F.floor(F.col("cell") / STEPS).cast("int") + 1)
    return total.select("part", order.alias("filter_order"), (F.col("cell") % STEPS + 1).cast("int").alias("step"), *FIGURES)
