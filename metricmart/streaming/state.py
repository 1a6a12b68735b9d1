"""Keyed state in Spark's state store: differences, expiry by event timers, exactly-once contents.

State is kept by key or by bucket of keys where the stream runs, so a micro-batch touches only the keys or
buckets that came, and what a restart reads is the checkpoint. Sinks are files in append mode.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metricmart.session import folder


@dataclass
class Run:
    """A stream that may be run again and again over what has come: the same checkpoint and sink each time."""

    spark: SparkSession
    schema: str
    checkpoint: str
    sink: str
    late: int = 0  # rows that came behind the watermark and were left out, over all runs
    kept: int = 0  # rows of state after the last micro-batch

    @classmethod
    def new(cls, spark: SparkSession, schema: str) -> Run:
        return cls(spark, schema, folder(spark), folder(spark))

    def go(self, stream: DataFrame) -> Run:
        """Reads what has come since the last run."""
        q = stream.writeStream.format("parquet").outputMode("append").option("path", self.sink).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        for p in q.recentProgress:
            for op in p["stateOperators"]:
                self.late += op["numRowsDroppedByWatermark"]
                self.kept = op["numRowsTotal"]
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.sink)


def _typed(values: np.ndarray, none: np.ndarray):
    """Numbers as pandas arrays that keep whole numbers whole and NULL apart from NaN; other values hold their own NULLs."""
    array = {"i": pd.arrays.IntegerArray, "f": pd.arrays.FloatingArray}.get(values.dtype.kind)
    return array(values, none) if array else values


def _ranks(values: pd.Series) -> np.ndarray:
    """Numbers in the order of the values, NULLs last."""
    if values.dtype.kind in "ifM":
        return values.to_numpy()
    codes, names = pd.factorize(values, sort=True)
    return np.where(codes < 0, len(names), codes)


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _filled(types: dict[str, str], c: str) -> Column:
    """Without NULLs where pandas would turn whole numbers into doubles for them."""
    return F.coalesce(c, F.lit(0).cast(types[c])) if types[c] in _WHOLE else F.col(c)


def _bucket(types: dict[str, str], key: str, buckets: int) -> Column:
    """The bucket a key falls in; NULL and NaN have their own below 0."""
    alone = F.when(F.col(key).isNull(), -1)
    alone = alone.when(F.isnan(key), -2) if types[key] in ("float", "double") else alone
    return alone.otherwise(F.pmod(F.xxhash64(key), F.lit(buckets)))


def _codes(bucket: int, keys: pd.Series) -> tuple[np.ndarray, list]:
    """The keys numbered from 0, and each number's key."""
    if bucket < 0:  # all rows have the one key that is NULL or NaN
        return np.zeros(len(keys), "int64"), [None]
    codes, names = pd.factorize(keys)
    return codes, names.tolist()


def differences(stream: DataFrame, key: str, time: str, id_: str, value: str, buckets: int = 1024) -> tuple[DataFrame, str]:
    """(key, id, delta) of each row: its value less that of the key's row before (by time, then id, NULLs last), NULL for
    the first or where either is NULL. The state is each key's last value, by buckets of keys: a call of Python costs
    milliseconds, so a micro-batch makes one for a bucket and not for each key, and rewrites the state of the buckets
    that came. ``buckets`` belongs to the checkpoint. A bucket's rows of one micro-batch are sorted in one task, so the
    stream's trigger (maxFilesPerTrigger) bounds them. Rows come in order of time from batch to batch."""
    types = dict(stream.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts), ignore_index=True)
        codes, names = _codes(k[0], pdf["key"])
        order = np.lexsort((_ranks(pdf["id"]), pdf["no_id"].to_numpy(), _ranks(pdf["time"]), codes))
        key_, id_s, no_id, x, null = (pdf[c].to_numpy()[order] for c in ("key", "id", "no_id", "x", "no_x"))
        first = np.diff(codes[order], prepend=-1) > 0
        last = np.append(first[1:], True)
        before, none = np.append(0.0, x[:-1]), np.append(True, null[:-1])
        kept = dict(zip(*state.get)) if state.exists else {}
        old = [kept.get(name) for name in names]  # in order of the codes, as the first rows are
        before[first], none[first] = [0.0 if v is None else v for v in old], [v is None for v in old]
        kept.update(zip(names, (None if n else v for v, n in zip(x[last].tolist(), null[last].tolist()))))
        state.update((list(kept), list(kept.values())))
        with np.errstate(invalid="ignore"):
            delta = x - before
        yield pd.DataFrame({key: _typed(key_, np.full(len(pdf), k[0] == -1)), id_: _typed(id_s, no_id), "delta": _typed(delta, null | none)})

    at = F.unix_micros(time) if types[time] == "timestamp" else F.col(time)
    rows = stream.select(
        _bucket(types, key, buckets).alias("bucket"), _filled(types, key).alias("key"),
        F.coalesce(at.cast("long"), F.lit(2**63 - 1)).alias("time") if types[time] in ("timestamp", *_WHOLE) else at.alias("time"),
        _filled(types, id_).alias("id"), F.col(id_).isNull().alias("no_id"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"), F.col(value).isNull().alias("no_x"),
    )
    schema = f"{key} {types[key]}, {id_} {types[id_]}, delta double"
    return rows.groupBy("bucket").applyInPandasWithState(step, schema, f"keys array<{types[key]}>, last array<double>", "append", GroupStateTimeout.NoTimeout), schema


def expired(stream: DataFrame, key: str, time: str, delay: str, hours: int, buckets: int = 1024) -> tuple[DataFrame, str]:
    """(key, last_seen, expired_at, n) of each key that wasn't seen for ``hours`` of event time, once the watermark reaches
    that time; it starts anew if it comes again. State lies by buckets of keys, as that of ``differences``, and a bucket's
    timer stands at the first of its keys that is due. Rows without a time are left out."""
    types, gap = dict(stream.dtypes), hours * 3_600_000_000  # times are microseconds below

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {name: (last, n) for name, last, n in zip(*state.get)} if state.exists else {}
        done, mark = [], state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            pdf = pd.concat(list(parts), ignore_index=True)
            codes, names = _codes(k[0], pdf["key"])
            order = np.lexsort((pdf["us"].to_numpy(), codes))
            code, t = codes[order], pdf["us"].to_numpy()[order]
            first = np.diff(code, prepend=-1) > 0
            old = [kept.get(name, (at, 0)) for name, at in zip(names, t[first].tolist())]
            seen, count = (np.array(x, "int64") for x in zip(*old))  # by code; a new key counts from its first row
            before = np.where(first, seen[code], np.maximum(seen[code], np.append(0, t[:-1])))
            due = t - before >= gap  # the key's timer was due before this row
            begins = np.flatnonzero(first | due)  # of rows that belong together
            last, n, who = t[np.append(begins[1:], len(t)) - 1], np.diff(np.append(begins, len(t))), code[begins]
            goes_on = first[begins] & ~due[begins]
            last, n = np.where(goes_on, np.maximum(last, seen[who]), last), n + np.where(goes_on, count[who], 0)
            done += [(names[c], int(seen[c]), int(count[c])) for c in code[first & due]]
            final = np.append(who[1:] != who[:-1], True)
            done += [(names[c], l, m) for c, l, m in zip(who[~final], last[~final].tolist(), n[~final].tolist())]
            kept.update((names[c], (l, m)) for c, l, m in zip(who[final], last[final].tolist(), n[final].tolist()))
        done += [(name, last, n) for name, (last, n) in kept.items() if last + gap <= mark * 1000]
        kept = {name: x for name, x in kept.items() if x[0] + gap > mark * 1000}
        if kept:
            state.update((list(kept), *map(list, zip(*kept.values()))))
            # timers fire once the watermark is beyond them, and a key is due when the watermark reaches last + gap
            state.setTimeoutTimestamp(max((min(last for last, _ in kept.values()) + gap - 1) // 1000, 1))  # never before the watermark
        elif state.exists:
            state.remove()
        if done:
            names, last, n = zip(*done)
            yield pd.DataFrame({key: list(names), "last_seen": last, "expired_at": [x + gap for x in last], "n": n})

    rows = stream.where(F.col(time).isNotNull()).select(_bucket(types, key, buckets).alias("bucket"), _filled(types, key).alias("key"), time, F.unix_micros(time).alias("us"))
    made = rows.withWatermark(time, delay).groupBy("bucket").applyInPandasWithState(
        step, f"{key} {types[key]}, last_seen long, expired_at long, n long", f"keys array<{types[key]}>, last array<long>, n array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return made.select(key, F.timestamp_micros("last_seen").alias("last_seen"), F.timestamp_micros("expired_at").alias("expired_at"), "n"), f"{key} {types[key]}, last_seen timestamp, expired_at timestamp, n long"


def first_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key's first row; further ones are dropped while they lie within ``delay`` of it, and state is given up after
    that, so it doesn't grow with the stream. Rows behind the watermark are left out (``Run.late`` counts them)."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def in_slices(df: DataFrame, time: str, slices: int) -> Iterator[DataFrame]:
    """A table as a stream whose files come in ``slices`` parts of falling age: after each part the stream is handed out,
    to be run over what is new. Rows without a time come last, as SQL orders them."""
    spark, at = df.sparkSession, folder(df.sparkSession)
    us = F.coalesce(F.unix_micros(time), F.lit(2**63 - 1))
    cuts = sorted(set(df.select(F.unix_micros(time).alias("us")).approxQuantile("us", [k / slices for k in range(1, slices)], 0.01)))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = F.lit(True) if lo is None else us > lo
        df.where(part if hi is None else part & (us <= hi)).write.mode("append").parquet(at)
        yield spark.readStream.schema(df.schema).parquet(at)
