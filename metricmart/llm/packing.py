"""Best-fit packing of documents into sequences of a fixed number of tokens (operator 2).

Each document is its token ids and an end id; only a document longer than a sequence is cut. Pieces are written once,
and spread by hash of their row in that table over shards of about ``per_shard`` rows; each shard is packed by sum of
squares: with N(g) the open bins of residual gap g, a piece goes where the sum of N(g)**2 gets smallest. Pieces of a
shard come longest first, which keeps the rule (it sees one piece at a time) and leaves the short ones to fill gaps. A
shard holds five numbers a piece and wastes a few bins at most. As rows are dealt and not ids, any number of pieces
without id, of one id or of one text spreads like all others, and memory is bounded whatever the documents are.

Null or empty texts are the end id alone. Texts of any length are cut into as many pieces as they need; strings of
added tokens (``<|endoftext|>``) are those tokens, as the tokenizer has it. Repeated rows, and rows without id, are
packed each on its own; ties go by doc_id and piece. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm.kernel import fresh, small_batches, stored
from metricmart.llm.tokens import ChunkEncoder, default_tokenizer

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, keep: int = 600_000) -> DataFrame:
    """One row for each piece of each document: its place in the document, length and checksum, and its ids if asked for.
    ``keep``: words whose ids a worker remembers (some 200 bytes each)."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, keep)
        for batch in batches:
            doc_id = batch.column(0).to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column(0).is_null())
            for row, ids, ends in encoder.encode(batch.column(1), end_id):
                size = np.diff(ends)
                n = -(-size // capacity)
                of = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[of] - start, capacity)
                at = (ends[of] + start).tolist()
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a : a + k]) for a, k in zip(at, length.tolist())]
                cols = [pa.array(doc_id[row + of].astype("float64" if null.any() else "int64"), pa.int64(), mask=null[row + of]) if not null.any() else batch.column(0).take(pa.array(row + of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([raw[a : a + k] for a, k in zip(at, length.tolist())], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed in the order given."""
    n_open = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    far = np.int64(1) << 40
    for k, s in enumerate(lengths.tolist()):
        here = n_open[s:]
        # growth of the sum of squares; a gap filled wholly leaves the open bins
        grown = np.where(here > 0, 2 * (n_open[: capacity + 1 - s] - here + 1), far)
        if here[0] > 0:
            grown[0] = 1 - 2 * here[0]
        g = int(grown.argmin())
        if grown[g] <= 2 * n_open[capacity - s] + 1 and s < capacity:
            gap = g + s
            b = stacks[gap].pop()
            n_open[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            n_open[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_shard: int = 16_384) -> DataFrame:
    """Adds sequence_id (distinct over all shards) and offset (gapless within a sequence) to the pieces, which are read
    twice: a stored table, whose rows keep their numbers when a task is run again."""
    shards = max(1, -(-pieces.count() // per_shard))
    shard = fresh(pieces, "shard")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins * shards + pdf[shard].astype("int64")
        pdf["offset"] = offsets
        return pdf.drop(columns=shard)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return pieces.withColumn(shard, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).groupBy(shard).applyInPandas(packed, schema)


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    return pack(stored(tokenized_pieces(docs, capacity, tokenizer, end_id)), capacity)
