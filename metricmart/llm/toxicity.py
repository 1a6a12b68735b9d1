"""Toxicity of deobfuscated text (operator 7).

Noisy channel: a word as it stands may be a plain word whose letters were swapped for look-alikes (``1d10t``),
spaced out (``i d i o t``, ``i.d.i.o.t``) or repeated (``idiooot``). Each suspicious word, and each run of single
letters, becomes a lattice: an arc for each letter that a sign may stand for, for each length of a repeated letter,
and between the letters of a run one that goes on with the word and one that begins another. Viterbi finds the path
that a character language model, and a price for each change, make likeliest, over words and runs of any length. The
model counts character 4-grams over all texts. The restored text is then scored by a linear model over whole words and
word beginnings, learned from up to 2 * ``most`` distinct texts of either label; their features are counted in parallel.

Null and empty texts get the score of a text without features. Repeated rows and ties score alike; rows without id are
scored like others and never trained on. Texts are read whole. Extra columns pass through, but for score, which is
replaced. Without toxic rows in training every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm import kernel

#: Look-alikes (fixed values).
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
JOINERS = ".-_*"
_SYMBOLS = 28  # 0 boundary, 1 to 26 letters, 27 any other letter
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[0x80:] = 27
_EDGE = kernel.SPACES.copy()  # of words as the scorer sees them
_EDGE[[ord(c) for c in ".,;:?\"'()[]{}<>#%&*~^/\\=_"]] = True
_LETTER = _CODE > 0
_SWAP = np.zeros(256, bool)
_SWAP[[ord(c) for c in LEET if ord(c) < 128]] = True
_RAW_EDGE = kernel.SPACES
_DIGITS = np.zeros(256, bool)
_DIGITS[[ord(c) for c in LEET if c in "0123456789@$"]] = True


def _four_gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SYMBOLS**4, np.int64)
    for batch in batches:
        for _, _, data, offsets in kernel.blocks(batch.column(0)):
            code = np.zeros(len(data) + 3, np.int64)
            code[3:] = _CODE[data]
            code[3:][(data & 0xC0) == 0x80] = 27
            at = (code[:-3] * _SYMBOLS + code[1:-2]) * _SYMBOLS**2 + code[2:-1] * _SYMBOLS + code[3:]
            total += np.bincount(at, minlength=_SYMBOLS**4)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c, d] of d after a, b, c, from the counts of all texts, smoothed with shorter contexts."""
    counts = np.zeros(_SYMBOLS**4)
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_four_gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # at most 28**4 rows
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy()
    c4 = counts.reshape((_SYMBOLS,) * 4)
    p = np.full(_SYMBOLS, 1 / _SYMBOLS)
    for c in (c4.sum((0, 1, 2)), c4.sum((0, 1)), c4.sum(0), c4):
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


def restored(word: str, model: np.ndarray, spaced: bool = False, swap: float = -1.0, repeat: float = -0.5, kept: float = -8.0) -> str:
    """The likeliest plain text. A look-alike is a letter at the price of ``swap``, or stays at that of ``kept``; of
    a run of one letter all but one or two may go. ``spaced``: a word may end after each letter."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", word.lower(), re.S)]
    paths: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}  # the best way to each context
    for at, (c, n) in enumerate(runs):
        plain = "a" <= c <= "z"
        options = [c] if plain else list(LEET.get(c, ""))
        arcs = [(x * k, (0.0 if plain else swap) * min(n, 2) + (repeat if k != n else 0)) for x in options for k in ({n} if n < 2 else {1, 2})]
        if not options:
            arcs = [(c * n, kept if c.isascii() else 0.0)]
        if spaced and at:
            arcs += [(" " + piece, cost) for piece, cost in arcs]
        new: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
        for (a, b, d), (value, back) in paths.items():
            for piece, cost in arcs:
                x, y, z, v = a, b, d, value + cost
                for ch in piece:
                    e = 0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27
                    v += float(model[x, y, z, e])
                    x, y, z = y, z, e
                if (x, y, z) not in new or v > new[x, y, z][0]:
                    new[x, y, z] = (v, (back, piece))
        paths = new
    _, back = max(((v + float(model[a, b, d, 0]), k) for k, ((a, b, d), (v, _)) in enumerate(paths.items())), default=(0.0, 0))
    back, pieces = list(paths.values())[back][1], []
    while back is not None:
        back, piece = back
        pieces.append(piece)
    return "".join(reversed(pieces))


def plain_words(word: str, model: np.ndarray) -> str:
    """A word as it stands, restored; one of single letters between joiners is a run of letters."""
    core = re.sub(r"^[^\w@$!|+(€]+|[^\w@$]+$", "", word)
    if re.fullmatch(r"[\w@$!|+(€](?:[.\-_*][\w@$!|+(€]){3,}", core):
        return restored(core[::2], model, spaced=True)
    core = re.sub(r"(?<=\w)[.\-_*](?=\w)", "", core) if re.search(r"(?:^|\W)\w(?:[.\-_*]\w)+(?:$|\W)", core) else core
    return " ".join(restored(x, model) for x in re.split(r"[^\w@$!|+(€]+", core) if x)


def _suspicious(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Words to decode, and runs (first, end) of at least four single letters or look-alikes of one row, two letters at least."""
    letter, swap = _LETTER[data], _SWAP[data]
    flag = np.zeros(len(data), bool)
    flag[:-1] |= swap[:-1] & letter[1:]  # a look-alike before a letter
    flag[1:] |= _DIGITS[data[1:]] & letter[:-1]  # or after one
    same = data[1:] == data[:-1]
    flag[:-2] |= same[:-1] & same[1:] & letter[:-2] & (data[:-2] < 128)  # three of one letter
    joiner = np.isin(data, np.frombuffer(JOINERS.encode(), np.uint8))
    flag[:-4] |= (letter | swap)[:-4] & joiner[1:-3] & (letter | swap)[2:-2] & joiner[3:-1] & (letter | swap)[4:]
    at = np.unique(np.searchsorted(starts, np.flatnonzero(flag), "right") - 1)
    single = np.zeros(len(starts) + 2, bool)
    single[1:-1] = (ends - starts == 1) & (letter | swap)[starts] & (data[starts] < 128)
    follows = single[:-1] & single[1:]
    follows[1:-1] &= row[1:] == row[:-1]
    first, last = np.flatnonzero(single[1:-1] & ~follows[:-1]), np.flatnonzero(single[1:-1] & ~follows[1:]) + 1
    return at, [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= 4 and letter[starts[a:b]].sum() >= 2]


def _beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the first n bytes of each word; 0 for shorter words."""
    h = np.full(len(starts), n, np.uint64)
    long = ends - starts >= n
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + kernel.FOLDED[data[np.minimum(starts + k, len(data) - 1)]]
    return np.where(long, kernel.mix(h), 0).astype(np.uint64)


def word_features(texts: pa.Array, model: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of each feature, 64-bit features) of restored texts, by block: whole words and beginnings of 4 and 6 bytes."""
    cache: dict[bytes, str] = {}
    for row, stop, data, offsets in kernel.blocks(texts):
        starts, ends, h, by_row = kernel.words(data, offsets, spaces=_EDGE)
        of = np.searchsorted(by_row, np.arange(len(starts)), "right") - 1
        raw_starts, raw_ends, _, raw_by_row = kernel.words(data, offsets, spaces=_RAW_EDGE)
        extra, extra_of = [], []
        if len(raw_starts):
            raw_row = np.searchsorted(raw_by_row, np.arange(len(raw_starts)), "right") - 1
            at, spaced = _suspicious(data, raw_starts, raw_ends, raw_row)
            raw = data.tobytes()
            for r, s, e in zip(raw_row[at].tolist(), raw_starts[at].tolist(), raw_ends[at].tolist()):
                w = raw[s:e]
                plain = cache.get(w)
                if plain is None:
                    plain = plain_words(w.decode("utf-8", "replace"), model)
                    if len(cache) < 200_000 and len(w) <= 64:
                        cache[w] = plain
                extra.append(plain)
                extra_of.append(r)
            for a, b in spaced:
                extra.append(restored("".join(chr(data[k]) for k in raw_starts[a:b].tolist()), model, spaced=True))
                extra_of.append(int(raw_row[a]))
        parts, rows_out = [h, _beginnings(data, starts, ends, 4), _beginnings(data, starts, ends, 6)] if len(starts) else [], [of] * 3 if len(starts) else []
        if extra:
            d = np.frombuffer(" ".join(extra).encode(), np.uint8)
            lens = np.array([len(x.encode()) + 1 for x in extra])
            o = np.concatenate([[0], np.cumsum(lens)])
            o[-1] = len(d)
            s2, e2, h2, b2 = kernel.words(d, o, spaces=_EDGE)
            if len(s2):
                of2 = np.array(extra_of)[np.searchsorted(b2, np.arange(len(s2)), "right") - 1]
                parts += [h2, _beginnings(d, s2, e2, 4), _beginnings(d, s2, e2, 6)]
                rows_out += [of2] * 3
        if parts:
            f, r = np.concatenate(parts), np.concatenate(rows_out)
            yield row, r[f > 0], f[f > 0]


def fit(train: DataFrame, labels: DataFrame, model: np.ndarray, most: int = 3000, width: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Features (ascending) and weights (the last is the constant). ``labels``: doc_id, y. ``most``: rows of either label."""
    kernel.small_batches(train.sparkSession)
    counts = {r.y: r["count"] for r in labels.groupBy("y").count().where("y in (0, 1)").collect()}
    if not counts.get(1):
        return np.zeros(0, np.uint64), np.array([-30.0])
    share = F.when(F.col("y") == 1, min(1.0, most / counts[1])).otherwise(min(1.0, most / max(counts.get(0, 0), 1)))
    some = labels.where("y in (0, 1)").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) / float(1 << 20) < share).select("doc_id", "y").limit(4 * most)  # few enough to broadcast
    drawn = train.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("text", F.col("y").cast("int").alias("y"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    kept = train.sparkSession.sparkContext.broadcast(model)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, feats = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for row, r, f in word_features(batch.column(0), kept.value):
                rows.append(row + r)
                feats.append(f)
            pair = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(feats)], 1), axis=0)
            at = np.searchsorted(pair[:, 0], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(pair[:, 1].view(np.int64)))], names=["y", "k1", "k2", "features"])

    # an id may have any number of texts or copies: each text once, and of either label as many as are bounded
    each = kernel.stored(drawn.mapInArrow(extract, "y int, k1 long, k2 long, features array<long>").groupBy("y", "k1", "k2").agg(F.first("features").alias("features")))
    few = lambda y: each.where(F.col("y") == y).select("y", "k1", "k2").orderBy(F.xxhash64("k1", F.lit(3)), "k1", "k2").limit(2 * most)
    rows = kernel.stored(each.join(F.broadcast(few(1).unionByName(few(0))), ["y", "k1", "k2"], "left_semi").select("y", "features"))
    total = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not total.get(1):
        return np.zeros(0, np.uint64), np.array([-30.0])
    by_feature = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).where("n1 >= 2")
    odds = F.log((F.col("n1") + 0.1) / (total[1] + 1)) - F.log((F.col("n0") + 0.1) / (total.get(0, 0) + 1))
    best = by_feature.withColumn("odds", odds).where("odds > 1").orderBy(F.desc(F.round(F.col("odds") * F.sqrt("n1"), 9)), "f").limit(width).toPandas()  # bounded by width
    known = np.sort(best["f"].to_numpy(np.int64))
    base = counts[1] / (counts.get(0, 0) + counts[1])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.flatnonzero(np.isin(known, np.asarray(x.values))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["y", "at"])

    def train_one(pdf: pd.DataFrame) -> pd.DataFrame:
        """``pdf``: at most 4 * most texts of at most ``width`` kept features each."""
        pdf = pdf.assign(s=[",".join(map(str, x)) for x in pdf["at"]]).sort_values(["s", "y"], kind="stable")
        y = pdf["y"].to_numpy(float)
        ats = [np.append(np.asarray(x, np.int64), len(known)) for x in pdf["at"]]  # the constant last
        flat, size = np.concatenate(ats), np.array([len(x) for x in ats])
        of, first = np.repeat(np.arange(len(y)), size), np.cumsum(size) - size
        weight = np.where(y == 1, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
        w, m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.zeros(len(known) + 1)
        for t in range(1, 301):
            z = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[flat], first), -30, 30)))
            g = np.bincount(flat, (weight * (z - y))[of], len(w)) / len(y) + 1e-4 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return pd.DataFrame({"weights": [w.tolist()]})

    out = rows.mapInArrow(select, "y int, at array<int>").groupBy(F.lit("all")).applyInPandas(train_one, "weights array<double>").collect()
    weights, order = np.array(out[0].weights), np.argsort(known.view(np.uint64))
    return known.view(np.uint64)[order], np.append(weights[:-1][order], weights[-1])


def score(docs: DataFrame, model: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Adds the score to all columns of ``docs``."""
    names = [c for c in docs.columns if c != "score"]
    kernel.small_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast((model, *weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, w = kept.value
        table = np.zeros(1 << 20, bool)
        table[(known >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            z = np.full(len(batch), w[-1])
            for row, r, f in word_features(batch.column(batch.schema.get_field_index("text")), model) if len(known) else ():
                maybe = np.flatnonzero(table[(f >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, f[maybe]), len(known) - 1)
                hit = known[at] == f[maybe]
                seen = np.unique(np.stack([row + r[maybe][hit], at[hit]], 1), axis=0)
                z += np.bincount(seen[:, 0], w[seen[:, 1]], len(batch)) if len(seen) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(names).dtypes) + ", score double"
    return docs.select(names).mapInArrow(scored, schema)
