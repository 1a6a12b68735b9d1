"""Streams that come in several micro-batches give what one batch gives."""

import math
import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

import metricmart.plans.stream_queries  # noqa: F401  registers
from metricmart.plans.registry import ORACLE_SQL, QUERIES
from metricmart.streaming import state, tables


def _stream(spark, at, batches, schema):
    # a file for each micro-batch, read one at a time in the order of writing
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def test_state_spans_batches(spark, tmp_path):
    schema = "k string, t long, v long"
    batches = [[("a", 1, 10), ("b", 1, 5), (None, 1, 1)], [("a", 3, 40), ("a", 2, 15), (None, 2, 4)], [("b", 9, 6), ("c", 1, None), ("c", 2, 3)]]
    stream = _stream(spark, f"file://{tmp_path}/in", batches, schema)
    kept = {tuple(r) for r in tables.latest_rows(stream, ["k"], ["t"]).collect()}
    assert kept == {("a", 3, 40), ("b", 9, 6), ("c", 2, 3), (None, 2, 4)}
    deltas = {(r.k, r.t): r.delta for r in tables.keyed_differences(stream, ["k"], ["t"], "v").collect()}
    assert deltas[("a", 2)] == 5 and deltas[("a", 3)] == 25 and deltas[("b", 9)] == 1
    assert deltas[("a", 1)] is None and deltas[("c", 2)] is None
    assert len(deltas) == 9


def test_null_keys_keep_their_state(spark, tmp_path):
    stream = _stream(spark, f"file://{tmp_path}/in", [[(None, 1, 1)], [(None, 2, 4)]], "k string, t long, v long")
    assert {r.t: r.delta for r in tables.keyed_differences(stream, ["k"], ["t"], "v").collect()} == {1: None, 2: 3}


def test_empty_stream(spark, tmp_path):
    stream = _stream(spark, f"file://{tmp_path}/in", [[]], "k string, t long, v long")
    assert tables.latest_rows(stream, ["k"], ["t"]).count() == 0
    out = tables.keyed_differences(stream, ["k"], ["t"], "v")
    assert out.count() == 0 and out.columns == ["k", "t", "v", "delta"]


def test_first_contents_once(spark, tmp_path):
    stream = _stream(spark, f"file://{tmp_path}/in", [[("a", 1, 1), ("b", 1, 1)], [("a", 2, 2), ("c", 3, 3)]], "k string, t long, v long")
    once = tables.appended(stream.select(F.sha2("k", 256).alias("h")).dropDuplicates(["h"]))
    assert once.count() == once.distinct().count() == 3


def test_tables_of_one_file_and_of_many(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string").repartition(3)
    at = f"file://{tmp_path}"
    rows.write.parquet(f"{at}/many/documents.parquet")
    rows.coalesce(1).write.parquet(f"{at}/one")
    (tmp_path / "single").mkdir()
    next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "single" / "documents.parquet")
    rows.write.parquet(f"{at}/single/labels.parquet")  # another table beside it
    for folder in ("many", "single"):
        assert tables.appended(tables.read_table(spark, f"{at}/{folder}", "documents")).count() == 4
        assert QUERIES["stream_content_skip"](spark, f"{at}/{folder}").count() == 3


def test_state_delta_calls_python_by_bucket(spark, tmp_path):
    # a row of state is a group that was called, at some milliseconds each
    at, run, schema = f"file://{tmp_path}/in", None, "k long, id long, t long, v double"
    for b in range(2):
        spark.range(3000).selectExpr("id as k", f"id + {3000 * b} as id", f"{b} as t", f"cast(id * {b + 1} as double) as v").selectExpr("k", "id", "cast(t as long) as t", "v").coalesce(1).write.mode("append").parquet(at)
        rows, s = state.differences(spark.readStream.schema(schema).parquet(at), "k", "t", "id", "v")
        run = (run or state.Run.new(spark, s)).go(rows)
    assert 0 < run.kept <= 1024
    got = {(r.k, r.id): r.delta for r in run.rows().collect()}
    assert got == {(k, k): None for k in range(3000)} | {(k, k + 3000): float(k) for k in range(3000)}


def test_state_delta_keeps_odd_values(spark, tmp_path):
    big, nan = 2**60 + 1, math.nan  # a double can't hold the id
    batches = [
        [(big, big, 1, 1.0), (None, 2, 1, 5.0), (0, None, 2, 3.0), (0, 3, 2, None), (7, 4, 1, nan), (8, 5, None, 2.0), (8, 6, 1, 1.0)],
        [(big, big + 2, 3, 4.0), (None, None, 3, 7.0), (0, 7, 4, 9.0), (7, 8, 3, 1.0), (8, 9, 3, 6.0), (9, 10, 3, math.inf), (9, 11, 4, math.inf)],
    ]
    want = {(big, big): None, (None, 2): None, (0, 3): None, (0, None): None, (7, 4): None, (8, 6): None, (8, 5): 1.0}
    want |= {(big, big + 2): 3.0, (None, None): 2.0, (0, 7): 6.0, (7, 8): "nan", (8, 9): 4.0, (9, 10): None, (9, 11): "nan"}
    stream = _stream(spark, f"file://{tmp_path}/in", batches, "k long, id long, t long, v double")
    for buckets in (1, 1024):
        rows, s = state.differences(stream, "k", "t", "id", "v", buckets)
        got = {(r.k, r.id): "nan" if r.delta is not None and math.isnan(r.delta) else r.delta for r in state.Run.new(spark, s).go(rows).rows().collect()}
        assert got == want


def test_state_delta_of_other_keys(spark, tmp_path):
    for n, (kind, a, b) in enumerate([("string", "x", None), ("double", 1.5, math.nan), ("timestamp", datetime(2024, 1, 1), datetime(2024, 7, 1))]):
        stream = _stream(spark, f"file://{tmp_path}/{n}", [[(a, "i", 1, 1), (b, "j", 1, 2)], [(a, "k", 2, 4), (b, None, 2, 8)]], f"k {kind}, id string, t int, v int")
        rows, s = state.differences(stream, "k", "t", "id", "v", 2)
        got = {(str(r.k), r.id): r.delta for r in state.Run.new(spark, s).go(rows).rows().collect()}
        assert got == {(str(a), "i"): None, (str(b), "j"): None, (str(a), "k"): 3.0, (str(b), None): 6.0}


def test_state_delta_without_times_as_in_sql(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, None if i % 7 == 3 else start + timedelta(minutes=i), None if i % 5 == 4 else i % 5, "view", None if i % 11 == 6 else i * 0.5, "{}") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(2).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select user_id, event_id, delta from ({ORACLE_SQL['stream_state_delta']})").fetchall()
    got = [(r.user_id, r.event_id, r.delta) for r in QUERIES["stream_state_delta"](spark, f"file://{tmp_path}").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_timers_call_python_by_bucket(spark, tmp_path):
    at, run = f"file://{tmp_path}/in", None
    for h in (0, 5):
        spark.range(3000).selectExpr("id as k", f"timestamp_seconds({h} * 3600 + id) as t").coalesce(1).write.mode("append").parquet(at)
        rows, s = state.expired(spark.readStream.schema("k long, t timestamp").parquet(at), "k", "t", "1 hour", 10)
        run = (run or state.Run.new(spark, s)).go(rows)
    assert run.rows().count() == 0 and 0 < run.kept <= 1024


def test_timers_share_a_bucket(spark, tmp_path):
    """Many keys on one timer, over several micro-batches, with rows that follow after an end, ties, NULL keys and times."""
    draw, start, gap = random.Random(7), datetime(2024, 1, 1), timedelta(hours=10)
    rows = sorted((start + timedelta(minutes=draw.randrange(14_400)), draw.choice([-1, *range(40)])) for _ in range(600))
    rows = [(None if k < 0 else 2**60 + k, t) for t, k in rows]
    batches = [rows[i : i + 100] + [(3, None)] for i in range(0, 600, 100)]
    stream = _stream(spark, f"file://{tmp_path}/in", batches, "k long, t timestamp")
    want, mark = [], max(t for _, t in rows) - timedelta(hours=1)
    for key in {k for k, _ in rows}:
        times = [t for k, t in rows if k == key]
        ends = [i for i in range(len(times)) if i + 1 == len(times) or times[i + 1] - times[i] >= gap]
        for a, b in zip([-1, *ends], ends):
            if times[b] + gap <= mark:
                want.append((key, times[b], times[b] + gap, b - a))
    for buckets in (1, 3, 1024):
        made, s = state.expired(stream, "k", "t", "1 hour", 10, buckets)
        got = [(r.k, r.last_seen, r.expired_at, r.n) for r in state.Run.new(spark, s).go(made).rows().collect()]
        assert len(want) > 100 and sorted(map(str, got)) == sorted(map(str, want))


def test_timers_due_a_millisecond_later(spark, tmp_path):
    """The watermark stands less than a millisecond before a key's end, and then moves by one."""
    start, ms = datetime(2024, 1, 1), timedelta(milliseconds=1)
    batches = [[(1, start + timedelta(microseconds=500)), (2, start + timedelta(hours=11))], [(2, start + timedelta(hours=11) + ms)]]
    for buckets in (1, 1024):
        made, s = state.expired(_stream(spark, f"file://{tmp_path}/{buckets}", batches, "k long, t timestamp"), "k", "t", "1 hour", 10, buckets)
        got = [tuple(r) for r in state.Run.new(spark, s).go(made).rows().collect()]
        assert got == [(1, batches[0][0][1], batches[0][0][1] + timedelta(hours=10), 1)]
