"""Operators on small tables: ties, nulls, repeats and empty inputs."""

import math
import statistics

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from metricmart.functions import scalar as S
from metricmart.functions import text as T
from metricmart.operators import dedupe, joins, ranking, robust

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40))
def test_tied_percentile(spark, values):
    df = spark.createDataFrame([(i, float(v) if v is not None else None) for i, v in enumerate(values)], "id long, v double")
    got = {r.id: r.p for r in ranking.percentile_tied(df, "v", "p").collect()}
    known = sorted(v for v in values if v is not None)
    for i, v in enumerate(values):
        if v is None:
            assert got[i] is None
        elif len(set(known)) == 1:
            assert got[i] == 50
        else:
            at = [k for k, x in enumerate(known) if x == v]
            assert abs(got[i] - 100 * statistics.mean(at) / (len(known) - 1)) < 1e-5


def test_ordinal_rank_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 9.0)], "id long, v double")
    assert {r.id: r.rank for r in ranking.ordinal_rank(df, "v", "id").collect()} == {4: 1, 1: 2, 2: 3, 3: None}


def test_robust(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 100)] + [("b", 7.0)], "g string, v double")
    rows = {r.g: r for r in robust.with_mad(df, "v", ["g"]).groupBy("g").agg(F.max("median").alias("m"), F.max("mad").alias("d"), robust.iqr_floor("v").alias("q")).collect()}
    assert (rows["a"].m, rows["a"].d, rows["a"].q) == (3.0, 1.0, 2.0)
    assert (rows["b"].d, rows["b"].q) == (0.0, None)


def test_order_statistics_meet_sorting(spark):
    """Groups of any sign and size, ties, a NULL group, a group without values, an empty table."""
    import random

    draw = random.Random(5)
    data = [(g, None if draw.random() < 0.1 else float(draw.choice([0, -1, 7, draw.gauss(0, 1e3), draw.random() * 1e-9]))) for g in ("a", "b", None) for _ in range({"a": 200, "b": 7, None: 12}[g])] + [("none", None), ("inf", float("inf")), ("inf", float("-inf"))]
    df = spark.createDataFrame(data, "value string, band double")  # names that clash with the operator's own
    picks = {"q1": robust.floor_quantile(0.25), "n": robust.disc_quantile(0.8), "up": robust.UPPER_MIDDLE}
    got = {r.value: (r.q1, r.n, r.up) for r in robust.order_statistics(df, "band", ["value"], picks).collect()}
    known = {}
    for g, v in data:
        known.setdefault(g, []).append(v)
    want = {}
    for g, v in known.items():
        v = sorted(x for x in v if x is not None)
        if v:
            want[g] = (v[int(0.25 * (len(v) - 1))], v[math.ceil(0.8 * len(v)) - 1], v[len(v) // 2])
    assert got == want
    flat = sorted(v for _, v in data if v is not None and abs(v) < math.inf)
    whole = robust.medians(df.where("abs(band) < double('infinity')"), "band", []).first()
    assert whole.median == statistics.median(flat)
    assert robust.medians(df.limit(0), "band", []).first().median is None and robust.medians(df.limit(0), "band", ["value"]).count() == 0


def test_asof_joins(spark):
    left = spark.createDataFrame([(1, 1, 10), (2, 1, 5), (3, 2, 9)], "id long, k long, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b")], "k long, t long, x string")
    got = {r.id: r.prev_x for r in joins.asof_backward(left, right, "k", "t", "t", ["x"]).collect()}
    assert got == {1: "b", 2: None, 3: None}  # strictly before


def test_merge_prefers_the_right(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert {r.k: r.v for r in joins.merge_right_biased(left, right, "k").collect()} == {1: "a", 2: None, 3: "c"}


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k long, t long, v string")
    assert {r.k: r.v for r in dedupe.keep_latest(df, ["k"], ["t"]).collect()} == {1: "y", 2: "z"}
    new = spark.createDataFrame([(1, 2, "n"), (9, 0, "m")], "k long, t long, v string")
    assert {r.k: r.v for r in dedupe.upsert(df, new, ["k"], ["t"]).collect()} == {1: "n", 2: "z", 9: "m"}
    assert dedupe.keep_latest(df.limit(0), ["k"], ["t"]).count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        S.safe_divide(F.lit(1), F.lit(0)).alias("zero"), S.safe_int(F.lit(" 12 ")).alias("i"), S.safe_int(F.lit("x")).alias("bad"), S.to_bool(F.lit(None).cast("string")).alias("no"),
        S.log1p_safe(F.lit(-1.0)).alias("log"), S.weighted_renormalised((0.5, F.lit(None).cast("double")), (0.5, F.lit(8.0))).alias("w"), T.iso_duration_seconds(F.lit("P1DT2H3M4S")).alias("s"), T.iso_duration_seconds(F.lit("?")).alias("s0"),
    ).first()
    assert (row.zero, row.i, row.bad, row.no, row.log, row.w, row.s, row.s0) == (None, 12, None, False, None, 8.0, 93784, 0)
