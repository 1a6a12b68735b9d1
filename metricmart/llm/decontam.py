"""Benchmark decontamination by rare seeds and local alignment (operator 5).

A seed is an ordered pair of an item's words, neighbours or with one word between; in a document the two may lie up to
three words apart. One pass counts the documents that hold each pair, and of an item's words the rarest (by the pairs
they start) keep their pairs: (1 - threshold) of its length and one more. That loses nothing: between two matches of an
alignment whose pair is no seed lie two edits at least, which take a match; so an alignment that reaches the threshold
has a seed at ``threshold`` times the item's length less one of its words, and all but that many are kept. Documents are
joined to items by their seeds (a broadcast hash join, block by block of items), a window as wide as any such alignment
is cut around the hits of each document and item, and aligned with the item by Smith-Waterman over word hashes. Two
bounds that no pair within reach of the threshold fails come first: on the item's words in the document, and within any
stretch an alignment can span.

Items come in blocks of bounded number and size by hash, each counted, broadcast and searched in a scan of its own, one
after another, so what a task holds is bounded whatever the benchmark's size.

Words are lower-cased runs without ASCII punctuation. Items of fewer than three words have no seed and match nothing.
Null and empty texts match nothing. Null ids stay null, and null item ids are items as others are; equal rows of
``benchmark`` count once. Repeated documents match alike, and ties of windows go to the first. Very long texts are
searched whole. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm import kernel

#: Words between a seed's first and second word: of an item, of a document.
OF_ITEMS, OF_TEXTS = (1, 2), (1, 2, 3)
_EDGE = kernel.SPACES.copy()
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Seeds:
    """Hashes ascending, and for each of its places the item and the word it starts at."""

    def __init__(self, h: np.ndarray, item: np.ndarray, at: np.ndarray, items: int):
        order = np.lexsort((at, item, h))
        h, self.item, self.at = h[order], item[order], at[order]
        self.unique, first = np.unique(h, return_index=True)
        self.items = max(items, 1)
        self.key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h)))) * self.items + self.item  # ascending
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.unique >> np.uint64(42)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of grams that are seeds, and their index in ``unique``."""
        maybe = np.flatnonzero(self.table[(grams >> np.uint64(42)).astype(np.int64)])
        if not len(self.unique) or not len(maybe):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u = np.minimum(np.searchsorted(self.unique, grams[maybe]), len(self.unique) - 1)
        hit = self.unique[u] == grams[maybe]
        return maybe[hit], u[hit]

    def places(self, u: np.ndarray, doc: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hit, place) of all places of the seeds ``u``, in parts of about ``most`` that hold all of a document and item."""
        todo = [(0, len(u), 0, self.items)]
        while todo:
            a, b, low, high = todo.pop()
            first = np.searchsorted(self.key, u[a:b] * self.items + low)
            n = np.searchsorted(self.key, u[a:b] * self.items + high) - first
            if n.sum() > most and doc[a] != doc[b - 1]:
                m = int(np.searchsorted(doc, doc[(a + b) // 2]))
                m = m if m > a else int(np.searchsorted(doc, doc[a], "right"))
                todo += [(m, b, low, high), (a, m, low, high)]
            elif n.sum() > most and high - low > 1:
                todo += [(a, b, (low + high) // 2, high), (a, b, low, (low + high) // 2)]
            elif n.sum():
                yield np.repeat(np.arange(a, b), n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def pairs(h: np.ndarray, by_row: np.ndarray, gaps: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gap the hashes of all ordered pairs of words of a row so far apart, and the first word's index."""
    row = np.repeat(np.arange(len(by_row) - 1), np.diff(by_row))
    for g in gaps:
        at = np.flatnonzero(row[:-g] == row[g:]) if len(h) > g else np.zeros(0, np.int64)
        yield kernel.mix(h[at] * np.uint64(0xD6E8FEB86659FD93) + h[at + g]), at


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, _, data, offsets in kernel.blocks(texts):
        _, _, h, by_row = kernel.words(data, offsets, spaces=_EDGE)
        yield row, h, by_row


def align(item: np.ndarray, text: np.ndarray, match: float = 1.0, mismatch: float = -0.5, gap: float = -0.5) -> float:
    """Best local alignment score over the item's length, from 0 to 1."""
    row, best = np.zeros(len(text) + 1), 0.0
    slope = -gap * np.arange(len(text) + 1)
    for w in item:
        new = np.zeros(len(text) + 1)
        new[1:] = np.maximum(row[:-1] + np.where(text == w, match, mismatch), 0)
        new = np.maximum(new, row + gap)
        row = np.maximum.accumulate(new + slope) - slope  # gaps in the item
        best = max(best, float(row.max()))
    return best / max(match * len(item), 1e-9)


def _held(words: list[np.ndarray], text: np.ndarray, threshold: float, most: int = 1 << 20) -> np.ndarray:
    """Whether of each item at least ``threshold`` of the words seem to be in the text (by a table of hashes)."""
    table = np.zeros(1 << 18, bool)
    table[(text >> np.uint64(46)).astype(np.int64)] = True
    out, size = np.zeros(len(words), bool), np.cumsum([len(w) for w in words])
    part = size // most
    for k in np.unique(part).tolist():
        a, b = np.searchsorted(part, [k, k + 1])
        flat = table[(np.concatenate(words[a:b]) >> np.uint64(46)).astype(np.int64)]
        lens = np.array([len(w) for w in words[a:b]])
        out[a:b] = np.add.reduceat(flat, np.cumsum(lens) - lens, dtype=np.int64) >= threshold * lens - 1e-9
    return out


def _stretches(item: np.ndarray, text: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Parts of the text that hold every alignment which reaches ``threshold``. Its matches are ``threshold`` times the
    item's length at least, and every gap takes half a match, so it spans no more than ``span`` words."""
    span = len(item) + int(2 * max(1 - threshold, 0) * len(item)) + 1
    total = np.concatenate([[0], np.cumsum(np.isin(text, item))])
    enough = threshold * len(item) - 1e-9
    if len(text) <= span:
        return [(0, len(text))] if total[-1] >= enough else []
    ok = np.concatenate([[False], total[span:] - total[:-span] >= enough, [False]])
    first, last = np.flatnonzero(ok[1:] & ~ok[:-1]), np.flatnonzero(ok[:-1] & ~ok[1:])
    return [(a, b - 1 + span) for a, b in zip(first.tolist(), last.tolist())]


def _items(benchmark: DataFrame, block: int, chars: int) -> list[DataFrame]:
    """item_id, text of the test items, in blocks of about ``block`` items and ``chars`` characters at most, by hash."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-size // chars))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def item_pairs(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, item and place of all pairs of items of three words or more."""
    by_item = np.concatenate([[0], np.cumsum([len(w) if len(w) >= 3 else 0 for w in words])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *[w for w in words if len(w) >= 3]])
    h, at = map(np.concatenate, zip(*pairs(flat, by_item, OF_ITEMS)))
    item = np.searchsorted(by_item, at, "right") - 1
    return h, item, at - by_item[item]


def _documents_with(hashes: np.ndarray, texts: DataFrame) -> np.ndarray:
    """How many documents hold each of the pairs (hashes ascending, at most those of a block of items)."""
    spark, none = texts.sparkSession, np.zeros(0, np.int64)
    sought = spark.sparkContext.broadcast(Seeds(hashes, np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sought.value.unique), np.int64)
        for batch in batches:
            for _, h, by_row in _words(batch.column(0)):
                hits = [(np.searchsorted(by_row, at[found], "right") - 1, of) for grams, at in pairs(h, by_row, OF_TEXTS) for found, of in [sought.value.find(grams)]]
                doc, of = map(np.concatenate, zip(*hits)) if hits else (none, none)
                n += np.bincount(np.unique(doc * len(n) + of) % len(n), minlength=len(n)) if len(doc) else 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    held = texts.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # a row a pair of the block
    out = np.zeros(len(hashes), np.int64)
    out[held["at"].to_numpy(np.int64)] = held["n"].to_numpy(np.int64)
    sought.destroy()
    return out


class _Searcher:
    """One block of items with the rarest of their seeds, made ready on the driver and broadcast. ``texts``: the documents'
    column ``text``, in which pairs are counted."""

    def __init__(self, items: DataFrame, texts: DataFrame, threshold: float):
        rows = items.orderBy("item_id", "text").collect()  # one block
        self.words = [np.zeros(0, np.uint64)] * len(rows)
        for row, h, by_row in _words(pa.array([r.text for r in rows], pa.string())):
            for k in range(len(by_row) - 1):
                self.words[row + k] = h[by_row[k] : by_row[k + 1]]
        self.ids = pa.array([r.item_id for r in rows], pa.int64())
        self.lengths, self.threshold = np.array([len(w) for w in self.words], np.int64), threshold
        h, item, at = item_pairs(self.words)
        sought = np.unique(h)
        held = _documents_with(sought, texts)[np.searchsorted(sought, h)]
        most = int(self.lengths.max(initial=0)) + 1
        place, of = np.unique(item * most + at, return_inverse=True)  # an item's words that start pairs
        common = np.bincount(of, held, len(place))
        order = np.lexsort((place, common, place // most))
        rank = np.empty(len(place), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(place[order] // most, place[order] // most)
        kept = (rank <= (1 - threshold) * self.lengths[place // most] + 1e-9)[of]
        self.seeds = Seeds(h[kept], item[kept], at[kept], len(rows))

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, score of the best window, its first word) for pairs that reach the threshold."""
        seeds, words, lengths, threshold = self.seeds, self.words, self.lengths, self.threshold
        for row, h, by_row in _words(texts):
            hits = []
            for grams, at in pairs(h, by_row, OF_TEXTS):
                found, of = seeds.find(grams)
                hits.append((at[found], of))
            hit, u = map(np.concatenate, zip(*hits))
            if not len(hit):
                continue
            order = np.argsort(hit, kind="stable")
            hit, u = hit[order], u[order]
            best: dict[tuple[int, int], tuple[float, int]] = {}
            hit_doc = np.searchsorted(by_row, hit, "right") - 1
            for at_hit, place in seeds.places(u, hit_doc):
                pos, item, item_at, doc = hit[at_hit], seeds.item[place], seeds.at[place], hit_doc[at_hit]
                order = np.lexsort((pos, item, doc))
                pos, item, item_at, doc = pos[order], item[order], item_at[order], doc[order]
                start = pos - item_at
                # hits farther apart than any alignment spans belong to different windows
                new = np.ones(len(pos), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > 3 * lengths[item[1:]])
                lo = np.flatnonzero(new)
                low, high = np.minimum.reduceat(start, lo), np.maximum.reduceat(start, lo)
                d_of, k_of = doc[lo], item[lo]
                for d in np.unique(d_of).tolist():
                    a, b = np.searchsorted(d_of, [d, d + 1])
                    begin, end = int(by_row[d]), int(by_row[d + 1])
                    for j in (a + np.flatnonzero(_held([words[k] for k in k_of[a:b]], h[begin:end], threshold))).tolist():
                        k = int(k_of[j])
                        length, w = int(lengths[k]), words[k]
                        more = int(2 * max(1 - threshold, 0) * length) + 3  # words that gaps can add on either side
                        first, last = max(begin, int(low[j]) - more), min(end, int(high[j]) + length + more)
                        for x, y in _stretches(w, h[first:last], threshold):
                            text = h[first + x : first + y]
                            if np.isin(w, text).mean() < threshold:  # no alignment can reach it
                                continue
                            value = align(w, text)
                            if value >= threshold and value > best.get((d, k), (0.0, 0))[0]:
                                best[d, k] = (value, first + x - begin)
            for (d, k), (value, first) in best.items():
                yield row + d, k, value, first


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block: int = 20_000, chars: int = 1 << 23) -> DataFrame:
    """doc_id, item_id, score (of the best window), start_word, for pairs that reach ``threshold``; one row a pair and document row."""
    kernel.small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def one(items: DataFrame) -> DataFrame:
        ready = docs.sparkSession.sparkContext.broadcast(_Searcher(items, texts, threshold))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(ready.value.search(batch.column(1)))
                if found:
                    row, item, score, start = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ready.value.ids.take(pa.array(item)), pa.array(score, pa.float64()), pa.array(start, pa.int64())], names=["doc_id", "item_id", "score", "start_word"])

        return texts.mapInArrow(search, "doc_id long, item_id long, score double, start_word long")

    blocks = _items(benchmark, block, chars)
    if len(blocks) == 1:
        return one(blocks[0])
    return reduce(DataFrame.union, [kernel.stored(one(items)) for items in blocks])


def without_items(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, block: int = 20_000, chars: int = 1 << 23) -> DataFrame:
    """The rows of ``docs`` (all columns) in whose text no test item is found; decided where the row lies, without a join."""
    kernel.small_batches(docs.sparkSession)
    blocks = _items(benchmark, block, chars)
    for k, items in enumerate(blocks):
        ready = docs.sparkSession.sparkContext.broadcast(_Searcher(items, docs.select(F.col("text").cast("string").alias("text")), threshold))

        def clean(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in ready.value.search(batch.column(batch.schema.get_field_index("text")))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        if k + 1 < len(blocks):  # one block in a task at a time
            docs = kernel.stored(docs)
    return docs
