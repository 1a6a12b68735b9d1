"""Approximate nearest neighbours over balanced posting lists (operator 6).

Centroids come from a bounded sample: it is halved again and again by two-means with equal halves, so lists are
balanced; the more vectors there are, the more lists. A vector goes to its nearest centroid and, if it lies at a
boundary, to all others within a distance ratio of the nearest. Centroids are searched by an in-memory graph of their
neighbours, which blocks of vectors walk together. A query reads the lists whose centroids lie within a distance ratio
of its nearest. Both ratios are measured, not guessed: the first is that at which sampled vectors lie in ``replicas``
lists on average, the second the least at which sampled vectors find the share ``recall`` of their true neighbours in
the sample in some list. So clustered vectors read few lists, and vectors without structure as many as they need; no
cap decides. Neighbouring lists are read together, as a shard, and a shard that grew too long in several parts. A query
goes once to each shard it asks, with the numbers of its lists there. Every vector is indexed; distances are exact on the
original vectors, so only the choice of lists is approximate.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of one dimension are searched
among themselves. Null ids take no part; of a repeated id the smallest vector counts. Ties go to the smaller id.
Distances beyond the range of doubles are infinite and rank last. Tables with fewer candidates than asked for return
all that share the dimension. Extra columns are not read. An empty table gives no rows.
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

OUT = "query_id long, rank int, vec_id long, score double"
AT_ONCE = 1 << 20  # numbers that an assignment to lists holds at once, in each of its few arrays


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, per_list: int, seed: int = 7) -> np.ndarray:
    """Means of clusters of at most ``per_list`` sample vectors."""
    rng, out, stack = np.random.default_rng(seed), [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        spread = x[at].std(0).max() if len(at) else 0
        if len(at) <= per_list or spread == 0:
            if len(at):
                out.append(x[at].mean(0))
            continue
        a, b = x[at[rng.integers(len(at))]], x[at[rng.integers(len(at))]]
        for _ in range(6):
            side = ((x[at] - a) ** 2).sum(1) - ((x[at] - b) ** 2).sum(1)
            order = np.argsort(side, kind="stable")
            half = len(at) // 2
            a, b = x[at[order[:half]]].mean(0), x[at[order[half:]]].mean(0)
        stack += [at[order[:half]], at[order[half:]]]
    return np.array(out)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1), 0)


def _ratios(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Distances to all centroids over that to the nearest."""
    d = np.sqrt(_squared(x, centroids))
    return d / np.maximum(d.min(1, keepdims=True), 1e-12)


def measured_ratios(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, replicas: float, asked: int = 512, seed: int = 5) -> tuple[float, float]:
    """(boundary, pruning) ratios. Boundary: within it a sample vector has ``replicas`` centroids on average. Pruning:
    the least within which a query meets one of the lists of each of its ``k`` nearest sample vectors, for the share
    ``recall`` of them and ``asked`` sample vectors. The sample is sparser than the table, so this errs upwards."""
    if len(centroids) < 2 or len(x) < 3:
        return 1.0, 1.0
    rng = np.random.default_rng(seed)
    some = rng.permutation(len(x))[:2048]
    near_all = np.empty((len(some), len(centroids)))
    for lo in range(0, len(some), 128):
        near_all[lo : lo + 128] = _ratios(x[some[lo : lo + 128]], centroids)
    near_all = near_all.ravel()
    near_all.sort()
    boundary = float(near_all[min(len(near_all), max(1, int(min(len(x), 2048) * replicas))) - 1])
    need = []
    for i in rng.permutation(len(x))[:asked].tolist():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[: min(k, len(d) - 1)]
        held = _ratios(x[near], centroids) <= boundary
        need.append(np.where(held, _ratios(x[i : i + 1], centroids), np.inf).min(1))
    return boundary, float(np.quantile(np.concatenate(need), recall))


class CentroidGraph:
    """Each centroid linked with its nearest ones and some far ones; blocks of vectors walk it together, best first. A
    vector that asks for a large share of all centroids is compared with all."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.x, n = centroids, len(centroids)
        links = [np.argsort(_squared(centroids[lo : lo + 1024], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for lo in range(0, n, 1024)]
        near = np.concatenate(links) if links else np.zeros((0, 0), np.int64)
        far = np.random.default_rng(3).integers(0, max(n, 1), (n, 4))  # these keep the graph connected
        pairs = np.unique(np.concatenate([np.stack([np.repeat(np.arange(n), m.shape[1]), m.ravel()], 1)[:, o] for m in (near, far) for o in ([0, 1], [1, 0])]), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        count = np.bincount(pairs[:, 0], minlength=n)
        self.links = np.repeat(np.arange(n)[:, None], max(1, count.max(initial=0)), 1)  # padded by the centroid itself
        self.links[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(count) - count, count)] = pairs[:, 1]
        self.hubs = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))  # spread, as the order is that of the splits

    def _evaluate(self, q: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for lo in range(0, len(rows), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            out[part] = ((q[rows[part]] - self.x[at[part]]) ** 2).sum(1)
        return out

    def search(self, q: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``q`` the indices and distances of about the ``breadth`` nearest centroids, nearest first."""
        n, many = len(self.x), len(q)
        breadth = min(breadth, n)
        found, opened = np.full((many, n), np.inf), np.zeros((many, n), bool)
        found[:, self.hubs] = self._evaluate(q, np.repeat(np.arange(many), len(self.hubs)), np.tile(self.hubs, many)).reshape(many, -1)
        active = np.arange(many)
        while len(active):
            best = np.argpartition(found[active], breadth - 1, axis=1)[:, :breadth] if breadth < n else np.repeat(np.arange(n)[None], len(active), 0)
            todo = ~opened[active[:, None], best] & np.isfinite(found[active[:, None], best])
            more = todo.any(1)
            active, best, todo = active[more], best[more], todo[more]
            r, c = np.nonzero(todo)
            opened[active[r], best[r, c]] = True
            step = max(1, AT_ONCE // self.links.shape[1])  # the centroids that most are near to have hundreds of links
            for lo in range(0, len(r), step):
                rs, cs = r[lo : lo + step], c[lo : lo + step]
                pairs = np.unique((active[rs][:, None] * n + self.links[best[rs, cs]]).ravel())
                rows, at = pairs // n, pairs % n
                unseen = ~np.isfinite(found[rows, at])
                rows, at = rows[unseen], at[unseen]
                found[rows, at] = self._evaluate(q, rows, at)
        order = np.argsort(found, axis=1, kind="stable")[:, :breadth]
        return order, np.sqrt(np.take_along_axis(found, order, 1))

    def within(self, q: np.ndarray, ratio: float, breadth: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``q``, centroid) for all centroids within ``ratio`` of the nearest; a row's search widens until one
        lies beyond, or until it comes near a walk over all."""
        rows, lists, left, n = [], [], np.arange(len(q)), len(self.x)
        while len(left):
            if 16 * breadth >= n:  # a walk would meet nearly all
                d = np.sqrt(self._evaluate(q, np.repeat(left, n), np.tile(np.arange(n), len(left)))).reshape(-1, n)
                r, c = np.nonzero(d <= ratio * d.min(1, keepdims=True) + 1e-12)
                rows.append(left[r])
                lists.append(c)
                break
            at, d = self.search(q[left], breadth)
            inside = d <= ratio * d[:, :1] + 1e-12
            done = ~inside[:, -1]
            r, c = np.nonzero(inside & done[:, None])
            rows.append(left[r])
            lists.append(at[r, c])
            left, breadth = left[~done], breadth * 4
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _assigned(graph: CentroidGraph, batch: pa.RecordBatch, ratio: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch of rows (id, v), each with (row of the part, list) for the lists within ``ratio``, by row."""
    block = max(1, min(512, AT_ONCE // len(graph.x)))
    for lo in range(0, len(batch), block):
        part = batch.slice(lo, block)
        q = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            rows, lists = graph.within(q, ratio)
        order = np.lexsort((lists, rows))
        yield part, rows[order], lists[order]


def _at_once(batch: pa.RecordBatch) -> int:
    """Rows with a vector in a batch of output: a few MB, however many lists a vector lies in."""
    return max(1, AT_ONCE * len(batch) // max(1, len(batch.column(1).flatten())) // 2)


def _poster(graph, ratio: float):
    """mapInArrow function: rows (id, v) to (list, id, v) for each list of a vector."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = _at_once(batch)
            for part, rows, lists in _assigned(graph.value, batch, ratio):
                for lo in range(0, len(rows), most):
                    at = pa.array(rows[lo : lo + most])
                    yield pa.RecordBatch.from_arrays([pa.array(lists[lo : lo + most], pa.int32()), part.column(0).take(at), part.column(1).take(at)], names=["list", "id", "v"])

    return post


def _asker(graph, ratio: float, shards: int):
    """mapInArrow function: rows (id, v) to (shard, lists, id, v) for each shard that a query asks: its vector goes there
    once, whatever number of lists it reads."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(graph.value.x)
        for batch in batches:
            most = _at_once(batch)
            for part, rows, lists in _assigned(graph.value, batch, ratio):
                shard = lists.astype(np.int64) * shards // n
                begins = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (shard[1:] != shard[:-1])]) if len(rows) else np.zeros(0, np.int64)
                ends = np.append(begins, len(rows))
                for lo in range(0, len(begins), most):
                    first = begins[lo : lo + most]
                    cuts = ends[lo : lo + len(first) + 1]
                    own = pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), pa.array(lists[cuts[0] : cuts[-1]], pa.int32()))
                    at = pa.array(rows[first])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int32()), own, part.column(0).take(at), part.column(1).take(at)], names=["shard", "lists", "id", "v"])

    return ask


def _distances(v: np.ndarray, one: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        diff = v - one
        d = np.sqrt((diff**2).sum(1))
        far = ~np.isfinite(d)
        if far.any():  # squares beyond the range of doubles
            top = np.abs(diff[far]).max(1, keepdims=True)
            d[far] = np.where(np.isfinite(top[:, 0]), top[:, 0] * np.sqrt(((diff[far] / np.where(np.isfinite(top), top, 1)) ** 2).sum(1)), np.inf)
    return d


def _dealt(vectors: DataFrame, queries: DataFrame, n: int, k: int, sample: int, per_list: int, replicas: float, recall: float, part: int) -> tuple[DataFrame, DataFrame, int, int]:
    """(list, id, v) of all vectors, (shard, lists, id, v) of the queries, and the numbers of lists and shards.
    Lists near each other have near numbers."""
    spark, dim = vectors.sparkSession, len(vectors.first().v)
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20) < sample / n).limit(2 * sample)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.stack(pdf["v"]).astype(np.float64), axis=0)  # copies count once
        with np.errstate(over="ignore", invalid="ignore"):
            c = balanced_centroids(x, max(8, int(np.ceil(len(x) * per_list / n))))
            boundary, ratio = measured_ratios(x, c, k, recall, replicas)
        return pd.DataFrame({"c": list(c), "boundary": boundary, "ratio": ratio})

    found = picked.groupBy(F.lit("all")).applyInPandas(cluster, "c array<double>, boundary double, ratio double").toPandas()  # sample / 4 rows at most
    centroids = np.stack(found["c"]) if len(found) else np.zeros((1, dim))
    finite = lambda c, other: float(found[c].iloc[0]) if len(found) and np.isfinite(found[c].iloc[0]) else other
    if not np.isfinite(centroids).all():
        centroids = np.zeros((1, dim))
    lists = len(centroids)
    shards = max(1, min(lists, -(-int(n * replicas) // part)))  # neighbouring lists together, so a query meets few
    graph = spark.sparkContext.broadcast(CentroidGraph(centroids))
    posted = vectors.mapInArrow(_poster(graph, finite("boundary", 1.0)), "list int, id long, v array<double>")
    asked = queries.mapInArrow(_asker(graph, finite("ratio", np.inf), shards), "shard int, lists array<int>, id long, v array<double>")
    return stored(posted), stored(asked), lists, shards


def postings(vectors: DataFrame, queries: DataFrame, n: int, k: int, sample: int, per_list: int, replicas: float, recall: float, part: int = 16_384) -> tuple[DataFrame, DataFrame, int]:
    """(list, id, v) of all vectors and of the queries, and the number of lists: what is kept and read, a row a list."""
    posted, asked, lists, _ = _dealt(vectors, queries, n, k, sample, per_list, replicas, recall, part)
    return posted, asked.select(F.explode("lists").alias("list"), "id", "v"), lists


def _nearest_once(query: np.ndarray, near: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest of each query by distance and then id; a vector of several lists counts once."""
    order = np.lexsort((near, far, query))
    query, near, far = query[order], near[order], far[order]
    once = np.r_[True, (query[1:] != query[:-1]) | (near[1:] != near[:-1])] if len(query) else np.zeros(0, bool)
    query, near, far = query[once], near[once], far[once]
    best = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[best], near[best], far[best]


def _search(k: int, dim: int, cells: int = 1 << 21):
    """Cogrouped function: the ``k`` nearest vectors of a shard for each query, over the lists it asks for."""

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)

    def search(asked: pa.Table, posted: pa.Table) -> pa.Table:
        out, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        if asked.num_rows and posted.num_rows:
            own = asked.column("lists").combine_chunks()
            ql, at = own.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(asked.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
            qi, q = asked.column("id").to_numpy(), matrix(asked)
            order = np.lexsort((qi[at], ql))
            ql, at = ql[order], at[order]  # lists asked, and the query's row
            order = np.lexsort((posted.column("id").to_numpy(), posted.column("list").to_numpy()))
            xl, xi, x = posted.column("list").to_numpy()[order], posted.column("id").to_numpy()[order], matrix(posted)[order]
            with np.errstate(over="ignore", invalid="ignore"):
                qq, xx = (q**2).sum(1), (x**2).sum(1)
                for one in np.unique(ql).tolist():
                    lo, hi = np.searchsorted(xl, [one, one + 1])
                    a, b = np.searchsorted(ql, [one, one + 1])
                    step = max(1, cells // max(hi - lo, 1))
                    for s in range(a, b if hi > lo else a, step):
                        r = at[s : min(b, s + step)]
                        d = qq[r, None] - 2 * q[r] @ x[lo:hi].T + xx[None, lo:hi]
                        slack = 1e-9 * (qq[r] + xx[lo:hi].max())  # far more than the products' rounding
                        if np.isfinite(d).all() and hi - lo > k + 1:
                            keep = d <= (np.partition(d, k, axis=1)[:, k] + slack)[:, None]  # k and the query itself
                        else:
                            keep = np.ones(d.shape, bool)
                        row, col = np.nonzero(keep)
                        for p in range(0, len(row), cells // 16):
                            rs, cs = r[row[p : p + cells // 16]], lo + col[p : p + cells // 16]
                            other = qi[rs] != xi[cs]
                            rs, cs = rs[other], cs[other]
                            out.append((qi[rs], xi[cs], _distances(q[rs], x[cs])))
                            held += len(rs)
                        if held > cells:
                            out = [_nearest_once(*map(np.concatenate, zip(*out)), k)]
                            held = 0
        query, near, far = _nearest_once(*map(np.concatenate, zip(*out)), k)
        return pa.table({"query_id": query, "vec_id": near, "score": far})

    return search


def _nearest(vectors: DataFrame, queries: DataFrame, n: int, k: int, sample: int, per_list: int, replicas: float, recall: float, part: int) -> DataFrame:
    posted, asked, lists, shards = _dealt(vectors, queries, n, k, sample, per_list, replicas, recall, part)
    asks = max(1, -(-queries.count() // part))  # parts of the queries, so that a task's queries are bounded as its vectors are
    shard = F.floor(F.col("list").cast("long") * shards / lists).cast("int")
    sizes = posted.groupBy(shard.alias("shard")).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    posted = posted.withColumn("shard", shard).join(sizes, "shard").select("shard", "list", "id", "v", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("ask"))
    asked = asked.join(sizes, "shard").select("shard", "lists", "id", "v", F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dim = len(vectors.first().v)
    pairs = asked.groupBy("shard", "part", "ask").cogroup(posted.groupBy("shard", "part", "ask")).applyInArrow(_search(k, dim), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _usable_once(df: DataFrame) -> DataFrame:
    """Usable vectors with an id, stored; of a repeated id the smallest. Only repeated ids are shuffled with their vectors."""
    df = df.where("id is not null").where(usable(F.col("v"))).select("id", "v")
    twice = stored(df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not twice.isEmpty():
        least = df.join(twice, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        df = df.join(twice, "id", "left_anti").unionByName(least)
    return stored(df)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 20_000, per_list: int = 250, replicas: float = 4.0, recall: float = 0.95, part: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``, ``queries``: id, v (array<double>); a query's own id is no candidate.

    ``sample``: vectors that centroids and ratios are fitted on; ``per_list``: vectors a list is to hold before replicas
    (more, where the sample is too small for so many lists); ``replicas``: lists a vector lies in on average."""
    vectors, queries = _usable_once(vectors), _usable_once(queries)
    dims = vectors.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [_nearest(vectors.where(F.size("v") == r.d), queries.where(F.size("v") == r.d), r["count"], k, sample, per_list, replicas, recall, part) for r in dims]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], OUT)
