"""Title rules, topics, values and levels on edge cases."""

from pyspark.sql import functions as F

from metricmart.plans import rule_queries
from metricmart.functions import titles as N
from metricmart.sources import runs


def test_title_patterns(spark):
    rows = [("5 ERRORES que nadie ve?", True, True, "warning", 1.0, 0.0), ("Gemini vs ChatGPT", False, False, None, None, 2.0), ("plain words", False, False, "curiosity", 0.0, 0.0), (None, None, None, None, None, None), ("", False, False, "", 0.0, 0.0), ("Cómo ahorrar dinero paso a paso", False, False, None, 0.0, None)]
    df = spark.createDataFrame(rows, "t string, n boolean, q boolean, h string, a double, f double")
    got = [r.p for r in df.select(N.title_patterns(*[F.col(c) for c in "tnqhaf"]).alias("p")).collect()]
    assert got == [["numbered_list", "question", "warning", "mistake", "contrarian", "semantic_ai_tool"], ["new_tool", "comparison", "semantic_finance"], ["unknown"], ["unknown"], ["unknown"], ["promise_save", "tutorial_how_to"]]


def test_topics(spark):
    rows = [(5.0, 9.0, 1.0), (3.0, 3.0, 0.0), (0.0, 0.0, None), (None, 2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    first, second, best = N.two_best({k: F.col(k) for k in "abc"})
    assert [tuple(r) for r in df.select(first, second, best).collect()] == [("b", "a", 9.0), ("a", "b", 3.0), ("unknown", "unknown", 0.0), ("b", "unknown", 2.0)]
    sure = spark.createDataFrame([(50.0, 1, True), (50.0, 9, False), (0.0, 3, True), (100.0, 4, True)], "best double, hits int, title boolean")
    got = [(r[0], r[1]) for r in sure.select(N.topic_confidence(F.col("best"), F.col("hits"), F.col("title")), N.topic_confidence(F.col("best"), F.col("hits"), F.col("title"), latent=True)).collect()]
    assert got == [(52.5, 55.0), (55.0, 55.0), (0.0, 0.0), (100.0, 100.0)]


def test_values_and_levels(spark):
    six = spark.createDataFrame([(80.0, None, None, None, 40.0, None), (None,) * 6, (500.0, 500.0, None, None, None, None), (-5.0, None, None, None, None, 0.0)], ", ".join(f"c{i} double" for i in range(6)))
    assert [r[0] for r in six.select(N.transcription_value(*[F.col(f"c{i}") for i in range(6)])).collect()] == [70.0, 0.0, 100.0, 0.0]
    units = spark.createDataFrame([(0, 0, 0), (0, 999, 1), (10, 4000, 50_000), (7000, 0, 0)], "u long, c long, v long").select(N.quota_units(F.col("u"), F.col("c"), F.col("v")).alias("n"))
    assert [(r.n, r.s) for r in units.select("n", N.quota_status(F.col("n")).alias("s")).collect()] == [(0, "ok"), (1000, "soft_warning"), (5010, "warning"), (7000, "over_operational_limit")]
    states = spark.createDataFrame([(0, None), (1, 40.0), (1, 2.0), (2, 36.0), (2, 36.1)], "found int, age double")
    assert [r[0] for r in states.select(N.freshness(F.col("found"), 2, F.col("age"), 36)).collect()] == ["not_initialized", "stale_expected", "generation_error", "ready", "stale_expected"]
    risk = spark.createDataFrame([(39.9,), (40.0,), (70.0,)], "r double")
    assert [r[0] for r in risk.select(N.originality_status(F.col("r"))).collect()] == ["safe", "review", "risky"]


def test_texts_and_ids(spark):
    texts = spark.createDataFrame([("Ünï ÉCOLE  a_b!\t(x)",), ("123",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(N.plain_text(F.col("t"))).collect()] == ["ünï école a_b x", "123", "", None]
    assert [r[0] for r in texts.select(N.uppercase_share(F.col("t"))).collect()] == [54.5455, 0.0, 0.0, 0.0]
    ids = spark.createDataFrame([("a", "b", ["y", "x"])], "a string, b string, t array<string>").select(N.hashed_id("alrt_", 16, F.col("a"), F.col("b")).alias("i"), N.tags_fingerprint(F.col("t")).alias("f")).first()
    import hashlib

    assert ids.i == "alrt_" + hashlib.sha1(b"a|b").hexdigest()[:16] and ids.f == hashlib.sha256(b"x|y").hexdigest()


def test_deltas_with_missing_fields(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"entity_id": 1, "execution_date": "2024-01-02T00:00:00Z", "views_delta": 5, "likes_delta": "x", "is_new": true}\n\n{"entity_id": 2, "execution_date": "soon"}\n{"entity_id": 3, "execution_date": "2024-01-02T00:00:00Z"}\n')
    got = {r.entity_id: r for r in runs.read_deltas(spark, f"file://{tmp_path}/d.jsonl").collect()}
    assert set(got) == {1, 3} and (got[1].views_delta, got[1].likes_delta, got[1].is_new, got[1].tags_changed) == (5, None, True, False) and got[3].views_delta is None
    assert runs.read_deltas(spark, f"file://{tmp_path}/none").count() == 0


def test_texts_are_lowered_once(spark, tmp_path):
    """Rules on the same text share its lower case, so that the work per text doesn't grow with their number."""
    spark.createDataFrame([(1, "A nuevo ERROR", "s", 13)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    d = rule_queries._titled(spark, str(tmp_path))
    assert d._jdf.queryExecution().optimizedPlan().toString().lower().count("lower(text") == 1
    assert d.first().patterns == ["mistake", "new_tool", "semantic_ai_tool"]
