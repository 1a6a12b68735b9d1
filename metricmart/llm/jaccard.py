"""Near-duplicate join on word shingles by exact Jaccard similarity (operator 9).

The answer is exact up to collisions of 64-bit hashes. Steps, each a Spark job over narrow rows:

1. Every text becomes its set of hashed 5-word shingles. Texts with the same set are one class from here on, known by
   a digest of the set; ids take no part until the end, so null and repeated ids neither join nor part texts.
2. Shingles met several times within a batch are counted; the most frequent (a bounded table) go last in one global
   order. Two sets that reach the similarity share one of their first ``n - ceil(t n) + 1`` shingles in any such
   order, so only classes that share one of these are compared. The order decides the cost and never the result.
3. Stars: a class is compared with the leader of the shingles it shares most (first the class that meets most others,
   then random ones); links that hold join classes, which saves the trees the pairs within groups of copies.
   ``stars=0`` leaves everything to the trees and gives the same rows.
4. Signature trees: classes of different components that still share a shingle form a group. Each group is a tree
   whose nodes hold the OR of their members' shingle bitmaps, their range of set sizes and the most shingles that
   follow the shared one. Two trees are walked together, and a pair of nodes is left when even its largest possible
   overlap is too small, or when both sides lie in one component. A bitmap has as many bits as its set has shingles,
   or up to twice that. A group of many classes is split in blocks, and each pair of blocks is one task.
5. Pairs that are left are checked on their sets, and the components are closed.

Null or wordless texts have no shingles and link with nothing. Texts of fewer than five words are one shingle.
Repeated rows fall into one class. Rows without an id count as documents: they link others, and their component is the
smallest id that they reach (null if there is none). A text is never cut, whatever its length. Columns other than
doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricmart.llm import kernel
from metricmart.llm.components import components
from metricmart.llm.kernel import dropped, stored

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
NUM, DEN = 80, 100
#: Bits of the smallest bitmap.
BITS = 128
#: Groups of at most this many classes are searched for possible partners before their bitmaps are fetched.
SMALL_GROUP = 16


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct shingles ascending within each row, offsets by row), block by block."""
    for row, stop, data, offsets in kernel.blocks(texts):
        _, _, h, by_row = kernel.words(data, offsets)
        grams, at = kernel.ngrams(h, by_row, n)
        of = np.searchsorted(by_row, at, "right") - 1
        size = np.diff(by_row)
        for k in range(1, n):  # fewer words: the whole sequence is the one shingle
            short = np.flatnonzero(size == k)
            if len(short):
                v = np.full(len(short), k, np.uint64)
                for j in range(k):
                    v = v * np.uint64(0xD6E8FEB86659FD93) + h[by_row[short] + j]
                grams, of = np.concatenate([grams, kernel.mix(v)]), np.concatenate([of, short])
        order = np.lexsort((grams, of))
        grams, of = grams[order], of[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
        grams, of = grams[new], of[new]
        yield row, grams, np.searchsorted(of, np.arange(stop - row + 1))


def _digests(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(kernel.mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)))])
    return kernel.mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)).view(np.int64)


def widths(sizes: np.ndarray) -> np.ndarray:
    """Bits of a bitmap: the least power of two that is not below the set's size, and ``BITS`` at least."""
    return np.maximum(BITS, np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def bitmaps(grams: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value a row; each shingle sets one bit."""
    wide = widths(np.diff(offsets))
    begin = np.concatenate([[0], np.cumsum(wide)])
    bits = np.zeros(begin[-1], bool)
    of = np.repeat(np.arange(len(wide)), np.diff(offsets))
    bits[begin[of] + (grams & (wide[of] - 1).astype(np.uint64)).astype(np.int64)] = True
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer((begin // 8).astype(np.int32).tobytes()), pa.py_buffer(np.packbits(bits, bitorder="little").tobytes())])


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: id, keys, size, digest and bitmap of each row; kind 1: shingles of several rows that come together, with counts."""
    names, held = ["kind", "id", "key1", "key2", "n", "digest", "bitmap"], []

    def counted() -> pa.RecordBatch:
        g = np.concatenate(held) if held else np.zeros(0, np.uint64)
        held.clear()
        g.sort()
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(g)))
        many = np.flatnonzero(count >= 2)
        n = len(many)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), none, none, none, pa.array(count[many]), pa.array(g[first[many]].view(np.int64)), pa.nulls(n, pa.binary())], names=names)

    for batch in batches:
        for row, grams, offsets in shingle_sets(batch.column(3)):
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), *(batch.column(c).slice(row, n) for c in range(3)), pa.array(np.diff(offsets)), pa.array(_digests(grams, offsets)), bitmaps(grams, offsets)], names=names)
            held.append(grams)
            if sum(map(len, held)) > 2_000_000:
                yield counted()
    yield counted()


def _prefixes(frequent: np.ndarray, counts: np.ndarray, num: int, den: int):
    """``frequent``: shingles ascending, with their counts; others count 0. Emits each prefix shingle with its place."""
    table = np.zeros(1 << 20, bool)
    table[(frequent >> np.uint64(44)).astype(np.int64)] = True

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # digests given out by this task; only saves work
        for batch in batches:
            for _, grams, offsets in shingle_sets(batch.column(0)):
                n = np.diff(offsets)
                digest = _digests(grams, offsets)
                fresh = np.zeros(len(n), bool)
                fresh[np.unique(digest, return_index=True)[1]] = True
                fresh &= np.array([d not in seen for d in digest.tolist()], bool) & (n > 0)
                if len(seen) < 100_000:
                    seen.update(digest[fresh].tolist())
                of = np.repeat(np.arange(len(n)), n)
                count = np.zeros(len(grams), np.int64)
                maybe = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)]) if len(frequent) else np.zeros(0, np.int64)
                if len(maybe):
                    at = np.minimum(np.searchsorted(frequent, grams[maybe]), len(frequent) - 1)
                    count[maybe] = np.where(frequent[at] == grams[maybe], counts[at], 0)
                    changed = np.lexsort((grams, count, of))
                    grams, count = grams[changed], count[changed]
                rank = np.arange(len(grams)) - offsets[:-1][of]
                keep = (rank < (n - (num * n + den - 1) // den + 1)[of]) & fresh[of]
                o = of[keep]
                yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(digest[o]), pa.array(n[o].astype(np.int32)), pa.array(rank[keep].astype(np.int32)), pa.array(count[keep] > 0)], names=["token", "digest", "n", "pos", "frequent"])

    return emit


def _set_rows(wanted: np.ndarray):
    """Sets of the texts whose digest may be wanted (by a table of hashed digests), each once a block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams, offsets in shingle_sets(batch.column(0)):
                digest = _digests(grams, offsets)
                first = np.unique(digest, return_index=True)[1]
                slot = kernel.mix(digest.view(np.uint64)) & np.uint64(8 * len(wanted) - 1)
                ok = (wanted[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                keep = np.zeros(len(digest), bool)
                keep[first] = ok[first]
                size = np.where(keep, np.diff(offsets), 0)
                ends = np.concatenate([[0], np.cumsum(size[keep])])
                yield pa.RecordBatch.from_arrays([pa.array(digest[keep]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams[np.repeat(keep, np.diff(offsets))].view(np.int64)))], names=["digest", "grams"])

    return emit


def _reach(overlap, small, large, num: int, den: int):
    """Whether sets of these sizes with this overlap can reach the similarity."""
    return den * overlap >= num * (small + large - overlap)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows x 64-bit words) OR-ed down to ``words`` words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class SignatureTree:
    """Nodes over rows (lo, hi), halved down to ``leaf`` rows; rows are sorted by size and then bitmap.

    ``rest``: how many shingles of a row follow the one the group shares, itself included.
    """

    def __init__(self, size: np.ndarray, maps: np.ndarray, component: np.ndarray, rest: np.ndarray | None = None, leaf: int = 16):
        rest = size if rest is None else rest
        self.order = np.lexsort((maps[:, 0], size)) if len(size) else np.zeros(0, np.int64)
        self.size, self.maps, self.component, self.rest, self.leaf = size[self.order], maps[self.order], component[self.order], rest[self.order], leaf
        self.nodes: dict[tuple[int, int], tuple] = {}
        if len(size):
            self._build(0, len(size))

    def _build(self, lo: int, hi: int) -> tuple:
        if hi - lo <= self.leaf:
            c = self.component[lo:hi]
            clash = (self.size[lo:hi] - np.bitwise_count(self.maps[lo:hi]).sum(1)).max()  # most shingles that share a bit
            own = (np.bitwise_or.reduce(self.maps[lo:hi]), self.size[lo], self.size[hi - 1], c[0] if (c == c[0]).all() else None, clash, self.rest[lo:hi].max())
        else:
            mid = (lo + hi) // 2
            a, b = self._build(lo, mid), self._build(mid, hi)
            own = (a[0] | b[0], a[1], b[2], a[3] if a[3] == b[3] else None, max(a[4], b[4]), max(a[5], b[5]))
        self.nodes[lo, hi] = own
        return own


def tree_pairs(a: SignatureTree, b: SignatureTree, num: int = NUM, den: int = DEN) -> Iterator[np.ndarray]:
    """Row pairs of different components that may reach the similarity, as arrays of two columns; with a is b each pair once."""
    if not len(a.size) or not len(b.size):
        return
    stack = [((0, len(a.size)), (0, len(b.size)))]
    while stack:
        x, y = stack.pop()
        mx, lox, hix, cx, clash_x, rest_x = a.nodes[x]
        my, loy, hiy, cy, clash_y, rest_y = b.nodes[y]
        if cx is not None and cx == cy:
            continue
        # the largest overlap: the smaller size, what follows the shared shingle, or the common bits and what one row has beyond one a bit
        small = min(hix, hiy, rest_x, rest_y, int(np.bitwise_count(mx & my).sum()) + min(clash_x, clash_y))
        if not _reach(small, max(lox, small), max(loy, small), num, den):
            continue
        if x[1] - x[0] <= a.leaf and y[1] - y[0] <= b.leaf:
            for i in range(*x):
                for_j = np.arange(max(y[0], i + 1) if a is b else y[0], y[1])
                for_j = for_j[b.component[for_j] != a.component[i]]
                if len(for_j):
                    n, m = a.size[i], b.size[for_j]
                    top = np.minimum(n - np.bitwise_count(a.maps[i] & ~b.maps[for_j]).sum(1), m - np.bitwise_count(b.maps[for_j] & ~a.maps[i]).sum(1))
                    top = np.minimum(top, np.minimum(a.rest[i], b.rest[for_j]))
                    for_j = for_j[_reach(top, n, m, num, den)]
                    yield np.stack([np.full(len(for_j), a.order[i]), b.order[for_j]], 1)
            continue
        if x[1] - x[0] >= y[1] - y[0]:
            mid = (x[0] + x[1]) // 2
            parts = [((x[0], mid), y), ((mid, x[1]), y)]
        else:
            mid = (y[0] + y[1]) // 2
            parts = [(x, (y[0], mid)), (x, (mid, y[1]))]
        if a is b and x == y:  # the lower half of a node with itself, once
            mid = (x[0] + x[1]) // 2
            l, r = (x[0], mid), (mid, x[1])
            parts = [(l, l), (l, r), (r, r)]
        stack += parts


def _group_pairs(left: np.ndarray, right: np.ndarray | None, raw: np.ndarray, size: np.ndarray, component: np.ndarray, rest: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """Pairs of rows of one group (``right`` is None) or of two blocks; bitmaps of neighbouring widths meet folded."""
    wide = widths(size)

    def tree(at: np.ndarray, words: int) -> SignatureTree:
        maps = folded(np.frombuffer(b"".join(raw[at].tolist()), np.uint64).reshape(len(at), -1), words)
        return SignatureTree(size[at], maps, component[at], rest[at])

    for w in np.unique(wide[left]).tolist():
        own = left[wide[left] == w]
        if right is None:
            a = tree(own, w // 64)
            yield from (np.stack([own[x[:, 0]], own[x[:, 1]]], 1) for x in tree_pairs(a, a, num, den))
            others = [(w, 2 * w, left)]
        else:
            others = [(w, v, right) for v in (w // 2, w, 2 * w)]
        for w, v, side in others:
            that = side[wide[side] == v]
            that = that[(den * size[that] >= num * size[own].min()) & (num * size[that] <= den * size[own].max())]
            if len(that):
                words = min(w, v) // 64
                yield from (np.stack([own[x[:, 0]], that[x[:, 1]]], 1) for x in tree_pairs(tree(own, words), tree(that, words), num, den))


def _bucket_pairs(num: int, den: int):
    """Walks the trees of all groups (token, i, j) of a bucket."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["token", "i", "j"], kind="stable", ignore_index=True)
        raw = pdf["bitmap"].to_numpy()
        size, comp, digest, side = (pdf[c].to_numpy(np.int64) for c in ("n", "component", "digest", "block"))
        rest = size - pdf["pos"].to_numpy(np.int64)
        key = pdf[["token", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        ends = np.append(first[1:], len(pdf))
        found = [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(first.tolist(), ends.tolist()):
            i, j = key[lo, 1], key[lo, 2]
            at = np.arange(lo, hi)
            if i == j:
                found += _group_pairs(at, None, raw, size, comp, rest, num, den)
            else:
                found += _group_pairs(at[side[at] == i], at[side[at] == j], raw, size, comp, rest, num, den)
        p, q = np.concatenate(found).T
        return pd.DataFrame({"a": np.minimum(digest[p], digest[q]), "b": np.maximum(digest[p], digest[q])}).drop_duplicates()

    return walk


def _possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of digests whose sizes and bitmaps allow the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            keep = np.zeros(len(na), bool)
            for k, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64)[None], np.frombuffer(y.as_buffer(), np.uint64)[None]
                words = min(x.shape[1], y.shape[1])
                x, y = folded(x, words), folded(y, words)
                top = min(na[k] - int(np.bitwise_count(x & ~y).sum()), nb[k] - int(np.bitwise_count(y & ~x).sum()))
                keep[k] = _reach(top, na[k], nb[k], num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    side = lambda c: classes.select(F.col("digest").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "nb", "ma", "mb").mapInArrow(check, "a long, b long")


class _Sets:
    """The sets of classes as they are asked for, made from one text of each and kept in the shared folder."""

    def __init__(self, texts: DataFrame, slots: int = 1 << 24):
        self.texts, self.slots, self.parts = texts, slots, []

    def of(self, wanted: DataFrame) -> DataFrame:
        for part in self.parts:
            wanted = wanted.join(part.select("digest"), "digest", "left_anti")
        wanted = stored(wanted)
        if not wanted.isEmpty() or not self.parts:
            # a bit table of fixed size leaves most other texts in their task; the join decides
            def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    slot = kernel.mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(self_slots - 1)
                    yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(3)).astype(np.int64)), pa.array(np.left_shift(1, (slot & np.uint64(7)).astype(np.int64)))], names=["byte", "bit"])

            self_slots = self.slots
            bits = wanted.mapInArrow(fill, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()  # slots / 8 rows at most
            table = np.zeros(self.slots // 8, np.uint8)
            table[bits["byte"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.uint8)
            made = self.texts.select("text").mapInArrow(_set_rows(table), "digest long, grams array<long>")
            self.parts.append(stored(made.join(wanted.hint("shuffle_hash"), "digest", "left_semi").groupBy("digest").agg(F.first("grams").alias("grams"))))
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.union(part)
        return out


def _holding(pairs: DataFrame, sets: _Sets, num: int, den: int, share: int = 256) -> DataFrame:
    """Pairs (a, b) of digests whose sets reach the similarity. A set that many pairs ask for is dealt to several tasks."""
    pairs = stored(pairs.distinct())
    got = sets.of(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
    asked = pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    wide = pairs.join(asked, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).select("a", "b", "part")
    right = got.select(F.col("digest").alias("b"), F.col("grams").alias("gb")).join(asked, "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = wide.join(got.select(F.col("digest").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a").join(right.hint("merge"), ["b", "part"])
    overlap = F.size(F.array_intersect("ga", "gb"))
    return stored(both.where(den * overlap >= num * (F.size("ga") + F.size("gb") - overlap)).select("a", "b"))


def _partner(x: Column, y: Column, num: int, den: int) -> Column:
    """Whether two members of a group can reach the similarity if the group's shingle is the first they share."""
    rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    return (x["digest"] != y["digest"]) & (den * rest >= num * (x["n"] + y["n"] - rest))


def _members(tokens: DataFrame, num: int, den: int) -> DataFrame:
    """token, digest, n, pos, tokens: groups of classes that share prefix shingles (so many) and may be similar."""
    by_token = Window.partitionBy("token")
    shared = F.min("digest").over(by_token) != F.max("digest").over(by_token)
    rare = tokens.where("not frequent").select("token", "digest", "n", "pos", shared.alias("shared")).where("shared").select("token", "digest", "n", "pos").distinct()
    rare = rare.withColumn("m", F.count("*").over(by_token))
    member = F.struct("digest", "n", "pos")
    small = rare.where(F.col("m") <= SMALL_GROUP).groupBy("token").agg(F.collect_list(member).alias("all"))  # SMALL_GROUP at most
    small = small.select(F.filter("all", lambda x: F.exists("all", lambda y: _partner(x, y, num, den))).alias("all")).where(F.size("all") > 1)
    # groups of the same classes become one, with the best place of each
    small = small.select(F.xxhash64(F.array_sort(F.transform("all", lambda x: x["digest"]))).alias("token"), F.explode("all").alias("x")).groupBy("token", "x.digest").agg(F.first("x.n").alias("n"), F.min("x.pos").alias("pos"), F.count("*").alias("tokens"))
    often = tokens.where("frequent").select("token", "digest", "n", "pos").distinct()
    often = often.join(often.groupBy("token").count().where("count > 1").select("token"), "token")
    return stored(small.union(rare.where(F.col("m") > SMALL_GROUP).drop("m").union(often).withColumn("tokens", F.lit(1).cast("long"))))


def _classes(docs: DataFrame, num: int, den: int, frequent_kept: int, stars: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, key1, key2, n, digest of each row, and component (a digest) of each class that links with another."""
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text), text.alias("text"))
    kernel.small_batches(docs.sparkSession)
    profile = stored(texts.mapInArrow(_profile, "kind byte, id long, key1 long, key2 long, n long, digest long, bitmap binary"))
    rows = profile.where("kind = 0").select(F.col("id").alias("doc_id"), "key1", "key2", "n", "digest")
    classes = stored(profile.where("kind = 0 and n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap")))
    top = profile.where("kind = 1").groupBy(F.col("digest").alias("gram")).agg(F.sum("n").alias("n")).where("n >= 8").orderBy(F.desc("n"), "gram").limit(frequent_kept).toPandas()  # bounded by frequent_kept
    grams, counts = top["gram"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(grams)
    tokens = stored(texts.select("text").mapInArrow(_prefixes(grams[order], counts[order], num, den), "token long, digest long, n int, pos int, frequent boolean"))
    members = _members(tokens, num, den)
    dropped(tokens)

    # how many others a class meets over its tokens: a text that others were copied from meets most
    sets, edges, labelled = _Sets(texts), None, members.withColumn("component", F.col("digest"))
    if stars:
        sizes = members.groupBy("token").agg(F.count("*").alias("size"))
        met = members.join(sizes, "token").groupBy("digest").agg(F.sum(F.col("size") * F.col("tokens")).alias("met"))
        labelled = stored(labelled.join(met, "digest"))
    for k in range(stars):
        # pairs of components that the trees would meet: stars go on only while these are out of proportion
        left = labelled.groupBy("token", "component").count().groupBy("token").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1)")), F.lit(0))).first()[0]
        if k and left <= 64 * members.count():
            break
        order = F.struct(F.when(F.lit(k) == 0, -F.col("met")).otherwise(F.lit(0)), F.xxhash64("digest", F.lit(k)), "digest")
        leader = labelled.groupBy("token").agg(F.min_by(F.struct("digest", "component", "n"), order).alias("leader"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token", "leader")
        fits = den * F.least("n", "leader.n") >= num * F.greatest("n", "leader.n")
        pairs = labelled.join(leader, "token").where(fits & (F.col("component") != F.col("leader.component"))).groupBy("digest", F.col("leader.digest").alias("leader")).agg(F.sum("tokens").alias("shared"))
        pairs = pairs.groupBy("digest").agg(F.max_by("leader", F.struct("shared", "leader")).alias("leader")).select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b"))
        found = _holding(_possible(pairs.distinct(), classes, num, den), sets, num, den)
        edges = found if edges is None else edges.union(found)
        labelled = stored(labelled.drop("component").join(_near_labels(edges), "digest", "left").withColumn("component", F.coalesce("component", "digest")))
    # groups that still hold several components
    open_tokens = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    split = F.greatest(F.lit(1), F.ceil(F.col("size") / block).cast("int"))
    rest = labelled.join(open_tokens.select("token", split.alias("blocks")), "token").join(classes.select("digest", "bitmap"), "digest")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "component", "n", "pos", "bitmap")
    buckets = max(12, members.count() // 20_000)  # of groups; each bucket is some thousand rows
    pairs = rest.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(buckets))).applyInPandas(_bucket_pairs(num, den), "a long, b long")
    found = _holding(pairs, sets, num, den)
    label = components(found if edges is None else edges.union(found))
    return rows, label.select(F.col("node").alias("digest"), "component")


def _near_labels(edges: DataFrame) -> DataFrame:
    """digest, component: the least class within two links. Equal labels mean one component; unequal ones mean nothing."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    again = both.join(low.select(F.col("u").alias("v"), F.col("m").alias("far")), "v").groupBy("u").agg(F.min("far").alias("far"))
    return low.join(again, "u").select(F.col("u").alias("digest"), F.least("m", "far").alias("component"))


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("key1"), F.xxhash64(F.lit(1), text).alias("key2")


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN, frequent_kept: int = 500_000, stars: int = 3, block: int = 2048) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    rows, label = _classes(docs, num, den, frequent_kept, stars, block)
    named = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(label, "digest", "left").select("digest", "first_id", F.coalesce("component", "digest").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_digest = named.join(smallest, "component").select("digest", "component_id")
    return rows.join(by_digest, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """Keys (doc_id, key1, key2; see ``text_keys``) of one document of each group of near duplicates.

    It is the one with the smallest id (rows without id last), then the smallest keys. Documents without words each
    keep themselves: each distinct doc_id and text is one.
    """
    rows, label = _classes(docs, **({"num": NUM, "den": DEN, "frequent_kept": 500_000, "stars": 3, "block": 2048} | options))
    own = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key1", "key2")
    first = rows.where("n > 0").groupBy("digest").agg(F.min(own).alias("first")).join(label, "digest", "left")
    first = first.groupBy(F.coalesce("component", "digest")).agg(F.min("first").alias("first")).select("first.doc_id", "first.key1", "first.key2")
    return first.union(rows.where("n = 0").select("doc_id", "key1", "key2").distinct())
