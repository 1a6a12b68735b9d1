"""Stored merges, typed publishing, modes, and keyed stream state over several runs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from metricmart.operators.dedupe import mode_first_seen
from metricmart.sources import publish
from metricmart.sources.catalog import Catalog, replace_rule, tracking_rule
from metricmart.streaming import state

DAY = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def upkeep(catalog, rows, day, spark):
    return catalog.merge(spark.createDataFrame(rows, "k long, name string, at long"), tracking_rule("k", ["name"], F.lit(DAY(day)), 10), everywhere=True)


def test_tracking_over_runs(spark, tmp_path):
    schema = "k long, name string, first_seen date, last_seen date, until date, active boolean"
    c = Catalog(spark, f"file://{tmp_path}/c", ["k"], schema, 4)
    assert c.version() == 0 and c.read().count() == 0
    assert upkeep(c, [(1, "a", 1), (2, "", 1), (3, "c", 1), (3, "cc", 2)], 0, spark) == 1
    first = [(1, "a", DAY(0), DAY(0), DAY(10), True), (2, "", DAY(0), DAY(0), DAY(10), True), (3, "cc", DAY(0), DAY(0), DAY(10), True)]
    assert sorted(tuple(r) for r in c.read().collect()) == first
    for _ in range(2):  # a run again changes nothing
        upkeep(c, [(1, "  ", 1), (2, "b", 1), (4, None, 1)], 11, spark)
        assert sorted(tuple(r) for r in Catalog(spark, c.path, ["k"], schema).read().collect()) == [
            (1, "a", DAY(0), DAY(11), DAY(10), False), (2, "b", DAY(0), DAY(11), DAY(10), False), (3, "cc", DAY(0), DAY(0), DAY(10), False), (4, "", DAY(11), DAY(11), DAY(21), True),
        ]
    assert sorted(tuple(r) for r in c.read(1).collect()) == first
    c.vacuum()
    assert c.version() == 3 and c.read().count() == 4
    assert os.listdir(f"{tmp_path}/c/versions") and len([x for x in os.listdir(f"{tmp_path}/c/versions") if x.isdigit()]) == 1


def test_merge_touches_its_buckets_only_and_survives_failures(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c", ["k"], "k long, v string", 8)
    rows = lambda data: spark.createDataFrame(data, "k long, v string")
    rule = replace_rule(["k"], ["v"])
    c.merge(rows([(k, "old") for k in range(100)]), rule)
    before = c._list(1)["folders"]
    c.merge(rows([(5, "new"), (5, "newer"), (200, "x")]), rule)
    after = c._list(2)["folders"]
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2 and c.buckets == 8
    got = {r.k: r.v for r in c.read().collect()}
    assert got[5] == "newer" and got[200] == "x" and got[6] == "old" and len(got) == 101

    def fails(old, new):
        return rule(old, new).withColumn("v", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        c.merge(rows([(7, "never")]), fails)
    assert c.version() == 2 and {r.k: r.v for r in c.read().collect()} == got
    # another merge makes version 3 while this one runs
    other = Catalog(spark, c.path, ["k"], "k long, v string")

    def overtaken(old, new):
        other.merge(rows([(8, "other")]), rule)
        return rule(old, new)

    with pytest.raises(RuntimeError, match="another merge"):
        c.merge(rows([(7, "mine")]), overtaken)
    c.merge(rows([(7, "mine")]), rule)
    got = {r.k: r.v for r in c.read().collect()}
    assert (got[7], got[8], c.version()) == ("mine", "other", 4)
    assert c.merge(rows([]), rule) == 4
    c.vacuum(2)
    assert c.read(3).where("k = 7").first().v == "old" and len(os.listdir(f"{tmp_path}/c/data")) == len(set(c._list(3)["folders"].values()) | set(c._list(4)["folders"].values()))


def test_publishing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('whole,part,flag,mixed,empty,text,big,"a b"\n1,1.5,True,1,,x,99999999999999999999,"q ""z"", é"\n-2,3,False,2.,,1e5,1, \n,.5,,, ,True,2,007\n')
    manifest = publish.publish(spark, {"t": f"file://{tmp_path}/t.csv", "gone": f"file://{tmp_path}/none.csv"}, f"file://{tmp_path}/out")
    by = {r.name: r for r in manifest.collect()}
    assert by["gone"].status == "missing" and by["gone"].row_count == 0 and not (tmp_path / "out/gone").exists()
    assert dict(zip(by["t"].columns, by["t"].types)) == {"whole": "int", "part": "float", "flag": "bool", "mixed": "float", "empty": "string", "text": "string", "big": "float", "a b": "string"} and by["t"].row_count == 3
    rows = spark.read.json(f"file://{tmp_path}/out/t").orderBy("part").collect()
    assert [(r.whole, r.part, r.flag, r.mixed, r.empty, r.text) for r in rows] == [(None, 0.5, None, None, None, "True"), (1, 1.5, True, 1.0, None, "x"), (-2, 3.0, False, 2.0, None, "1e5")]
    assert rows[1]["a b"] == 'q "z", é' and rows[0]["a b"] == "007" and rows[2]["a b"] is None
    assert spark.read.json(f"file://{tmp_path}/out/manifest").count() == 2


def test_mode_with_ties(spark):
    rows = [("a", "x", 5), ("a", "y", 1), ("a", "x", 6), ("a", "y", 7), ("b", None, 1), ("b", None, 2), ("b", "z", 0), (None, "q", 3), ("c", "l", None), ("c", "k", 9)]
    got = mode_first_seen(spark.createDataFrame(rows, "g string, v string, at long"), ["g"], "v", "at").collect()
    assert {tuple(r) for r in got} == {("a", "y", 2), ("b", None, 2), (None, "q", 1), ("c", "k", 1)}


def _files(spark, at, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


T = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)


def test_state_over_restarts(spark, tmp_path):
    """Differences and timers over micro-batches and runs from one checkpoint."""
    batches = [[("a", T(0), 1, 10.0), ("a", T(1), 2, 15.0), (None, T(0), 3, 1.0)], [("a", T(2), 4, None), ("b", T(2), 5, 7.0), (None, T(3), 6, 4.0)], [("a", T(30), 7, 2.0), ("a", T(31), 8, 5.0)], [("c", T(60), 9, 0.0)]]
    schema = "k string, t timestamp, id long, v double"
    delta = gone = None
    for stream in _files(spark, f"file://{tmp_path}/in", batches, schema):
        rows, s = state.differences(stream, "k", "t", "id", "v")
        delta = (delta or state.Run.new(spark, s)).go(rows)
        rows, s = state.expired(stream, "k", "t", "1 hour", 10)
        gone = (gone or state.Run.new(spark, s)).go(rows)
    assert {r.id: r.delta for r in delta.rows().collect()} == {1: None, 2: 5.0, 3: None, 4: None, 5: None, 6: 3.0, 7: None, 8: 3.0, 9: None}
    assert delta.kept == 4
    assert {(r.k, r.last_seen, r.expired_at, r.n) for r in gone.rows().collect()} == {("a", T(2), T(12), 3), (None, T(3), T(13), 2), ("b", T(2), T(12), 1), ("a", T(31), T(41), 2)}
    assert gone.kept == 1  # only c still has state
    again, _ = state.expired(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "k", "t", "1 hour", 10)
    assert gone.go(again).rows().count() == 4  # nothing new


def test_bounded_dedupe_counts_late_rows(spark, tmp_path):
    batches = [[(1, T(0)), (1, T(0, 10)), (2, T(0, 30))], [(1, T(0, 40)), (3, T(5))], [(4, T(1)), (3, T(5, 20)), (5, T(9))], [(6, T(20))]]
    run, kept = None, []
    for stream in _files(spark, f"file://{tmp_path}/in", batches, "id long, t timestamp"):
        run = run or state.Run.new(spark, "id long, t timestamp")
        run.go(state.first_within(stream, ["id"], "t", "1 hour"))
        kept.append(run.kept)
    assert sorted(r.id for r in run.rows().collect()) == [1, 2, 3, 5, 6]
    assert run.late == 1  # (4, 1:00) came when the watermark stood at 4:00
    assert kept[-1] == 1 < 5  # state of the others is gone


def test_timer_due_at_the_watermark(spark, tmp_path):
    rows = [("a", T(0)), ("b", T(0) + dt.timedelta(milliseconds=1)), ("c", T(0) + dt.timedelta(microseconds=1)), ("z", T(11))]
    for stream in _files(spark, f"file://{tmp_path}/in", [rows], "k string, t timestamp"):
        made, s = state.expired(stream, "k", "t", "1 hour", 10)
        gone = state.Run.new(spark, s).go(made)
    assert {(r.k, r.expired_at) for r in gone.rows().collect()} == {("a", T(10))}  # the watermark stands at 10:00
