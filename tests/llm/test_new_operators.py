"""Secret scans, hard negatives and the filter audit against plain versions and odd tables."""

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from metricmart.llm import filteraudit, hardneg, secrets

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
Q = __spark_entry__.queries()
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def fixed_spans(text):
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def digests(docs):
    out = []
    for d, t in docs:
        spans = fixed_spans(t)
        n = [sum(s[0] == k for s in spans) for k in secrets.KINDS[:3]]
        out.append((d, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    return sorted(out, key=str)


TRICKY = [
    (1, 'é TOKEN = "aB3dE5fG7hI9" passwd:short secret=\'0123456789abcdef0\''), (2, "AKIAAKIAAKIAAKIAAK AKIA1 AKIA" + "Z9" * 8 + "akia"), (3, "token=secret=abcdefabcdefabcdef"),
    (4, "api_key: x apikey:yyyyyyyyyyyyyyyy API_KEY  =  ñ"), (5, None), (6, ""), (None, "token = deadbeefdeadbeefdeadbeef"), (7, "é" * 40 + "f" * 16 + "ü" + "0" * 15), (7, "ﬀ ſecret=abcdefghijkl TOKEN=abcdefghijklm"),
    (8, "x " * 100_000 + "password=" + "Q" * 70_000),
]


def test_op11_fixed_shapes_are_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert sorted((tuple(r) for r in Q["op11_secret_scan"](spark, SF).select(*columns).collect()), key=str) == digests(docs)
    odd = secrets.digest(secrets.scan(spark.createDataFrame(TRICKY, "doc_id long, text string")))
    assert sorted((tuple(r) for r in odd.select(*columns).collect()), key=str) == digests(TRICKY)


def test_op11_novelty(spark):
    """Random values after sensitive words are found, what the corpus and the surroundings explain is not."""
    rng = random.Random(4)
    rand = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    code = "def make_session_handler(request_context):\n    return session_handler.from_request(request_context)\n"
    key = rand(32)
    docs = [
        (1, f"{code}Authorization: Bearer {key}\n{code}"), (2, f"private_key is {rand(24)} here"), (3, f"the credential\n{rand(24)}"), (4, f"no hint {rand(24)} here"),
        (5, f"{code}bearer make_session_handler1\n"), (6, "token tokenizer_v2_settings and the credential your_api_key_here1"), (7, f"bearer {key} and again bearer {key}."), (8, "bearer 2024-01-05T00:00:00 and 1234.5678-90123"),
        *[(k, f"{code}Authorization: Bearer {key}\n{code}") for k in range(100, 140)],
    ]
    got = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == [("novel", key)] and len(got[2]) == 1 and got[2][0][0] == "novel"
    assert got[3] == got[4] == got[5] == got[6] == got[8] == []
    assert got[7] == [("novel", key)] * 2 and all(got[k] == got[1] for k in range(100, 140))


def test_op11_novelty_bounds():
    known = b" ".join(w.encode() for w in secrets.COMMON)
    rng = random.Random(1)
    for n in (12, 16, 40, 500):
        value = "".join(rng.choices(string.ascii_letters + string.digits, k=n)).encode()
        assert secrets.novelty(value, b"", known) >= 0.9 and secrets.novelty(value, value, known) < 0.6
    assert secrets.novelty(b"", b"", known) == 0 and 0 <= secrets.novelty(b"a" * 1000, b"", b"") < 0.5


def mined(rows, scale=256, positives=5, negatives=3):
    q = {i: (label, [int(np.floor(scale * x)) for x in v]) for i, label, v in rows}
    out = set()
    for a, (label, v) in q.items():
        if a % 50:
            continue
        score = {b: sum(x * y for x, y in zip(v, w)) for b, (_, w) in q.items() if b != a and len(w) == len(v)}
        first = lambda ids, k: sorted(ids, key=lambda b: (-score[b], b))[:k]  # noqa: E731, B023
        for p in first([b for b in score if q[b][0] == label], positives):
            ok = [b for b in score if q[b][0] != label and 50 * score[p] <= 100 * score[b] <= 95 * score[p]]
            out |= {(a, p, k, b, score[p], score[b]) for k, b in enumerate(first(ok, negatives), 1)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
ROWS = "id long, label long, v array<double>"


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_op12_is_brute_force(spark, block_bytes):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=4 if k % 9 else 3).round(1)]) for k in rng.permutation(1200)]
    rows += [(k, 1, [0.5, 0.5, 0.5, 0.5]) for k in range(2000, 2300)] + [(k, 2, [0.4, 0.4, 0.4, 0.4]) for k in range(3000, 3300)]  # ties
    rows += [(-50, 1, []), (-51, 1, []), (-52, 2, [])]
    got = hardneg.mine(spark.createDataFrame(rows, ROWS).repartition(7), F.col("id") % 50 == 0, block_bytes=block_bytes).select(*COLUMNS).collect()
    want = mined(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_op12_wide_numbers(spark):
    """Scores past 2^53, where float64 would round, and past the range of a long."""
    rng = np.random.default_rng(3)
    rows = [(k, k % 2, [float(x) for x in rng.integers(2**29, 2**30, 3) / 256]) for k in range(0, 120)]
    got = hardneg.mine(spark.createDataFrame(rows, ROWS), F.col("id") % 50 == 0).select(*COLUMNS).collect()
    want = mined(rows)
    assert {tuple(r) for r in got} == want and max(r.positive_score for r in got) > 2**53
    a = np.array([[2**40 + 1, 3]], object)
    assert hardneg.products(a, a).tolist() == [[2**63 - 1]] and hardneg.products(-a, a).tolist() == [[-(2**63)]]
    huge = hardneg.quantised(np.array([[1e300, 1e308]]), 256)
    assert huge[0, 1] == 256 * int(1e308)
    for s in (-7, 0, 1, 99, 2**62 + 1):
        assert [int(hardneg.times(np.array([s]), 95, 100, up=u)[0]) for u in (False, True)] == [95 * s // 100, -(-95 * s // 100)]


def test_op12_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.0]), (2, 2, [0.8, 0.0]), (2, 2, [0.8, 0.0]), (3, None, [0.8, 0.0]), (4, 2, [nan, 0.0]), (5, 2, [inf, 0.0]), (6, 2, None), (7, 2, [None, 1.0]), (None, 2, [0.8, 0.0]), (8, 2, [0.8]), (50, 3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, ROWS).withColumns({"rank": F.lit("x"), "block": F.lit(1), "at": F.lit(2)})
    assert [tuple(r) for r in hardneg.mine(df, F.col("id") % 50 == 0).select(*COLUMNS).collect()] == [(0, 1, 1, 2, 58880, 52224)]
    assert hardneg.mine(df.limit(0), F.col("id") % 50 == 0).collect() == []


def audited(docs, labels):
    first, sums, total = {}, {}, {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    for d, t, lang in docs:
        t, part = t or "", lang or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and first[t] < d}
        good, toxic = labels.get(d, (0, 0))
        total[part] = total.get(part, 0) + 1
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                x = sums.setdefault((part, order, step), [0] * 6)
                if fails[f] and not gone:
                    gone = True
                    x[1] += 1
                    x[4] += good
                    x[5] += toxic
                elif fails[f]:
                    x[2] += 1
                x[0] += not gone
                x[3] += fails[f] and sum(fails.values()) == 1
    shapley = {}
    for (part, order, step), x in sums.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + x[1]
    return {(*k, *x, shapley[k[0], k[1][k[2] - 1]]) for k, x in sums.items()}


def test_op13_is_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()]
    labels = {r["doc_id"]: (int(r["quality"] == 1), int(r["toxic"] == 1)) for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    got = [tuple(r) for r in Q["op13_filter_audit"](spark, SMALL).select("part", "filter_order", "step", *filteraudit.FIGURES).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(docs, labels)


def test_op13_odd_rows(spark):
    docs = [(1, None, None), (2, "", "en"), (2, "", "en"), (None, "", "en"), (3, "same", "de"), (3, "same", "en"), (4, "same", ""), (5, "A B " * 200, "en"), (6, "w " * 30_000, "fr"), (7, "x|y\x0bz\x1cq", "fr"), (None, None, None)]
    labels = [(5, 1, 1), (5, 0, None), (None, 1, 1), (4, None, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit(1), "fails": F.lit("x"), "n": F.lit(2), "key1": F.lit(3), "quality": F.lit(1), "least": F.lit(0)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = audited(docs, {5: (1, 1), 4: (0, 1)})
    for most in (256, 1):
        got = [tuple(r) for r in filteraudit.audit(df, marks, most_parts=most).select("part", "filter_order", "step", *filteraudit.FIGURES).collect()]
        assert len(got) == 4 * 600 and set(got) == want
    assert filteraudit.audit(df.limit(0), marks).collect() == []
