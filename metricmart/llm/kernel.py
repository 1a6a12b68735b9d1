"""Vectorised helpers that run inside Spark tasks on Arrow buffers.

Texts stay UTF-8 bytes in one buffer with row offsets, so no Python object is made per text or word.
Work goes in blocks of about ``BLOCK_BYTES``; a single longer text is a block of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 1 << 20
#: Separators of words: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _byte_values(fold: bool) -> np.ndarray:
    t = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if fold:
        t[65:91] = t[97:123]
    return t


RAW, FOLDED = _byte_values(False), _byte_values(True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _grown_powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_P, _P_INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers


def blocks(texts: pa.Array, most: int = BLOCK_BYTES, most_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) over a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(texts), row + most_rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    del texts, data, offsets
    pa.default_memory_pool().release_unused()  # a reused worker would keep what a batch has freed


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = FOLDED, spaces: np.ndarray = SPACES, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends and 64-bit hashes of all words, and word offsets by row. ``cuts``: where else words end."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~spaces[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    power, inverse = _grown_powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, h, np.searchsorted(starts, offsets)


def ngrams(h: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences that lie within a row, and the index of each one's first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    out = np.full(m, np.uint64(n))
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    ok = np.ones(m, bool)
    for e in range(1, n):
        at = word_offsets[1:-1] - e
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


def hashed_bytes(data: np.ndarray, offsets: np.ndarray, n: int, dim: int) -> np.ndarray:
    """rows x dim counts of byte n-grams (hashed; dim is a power of two). ``data`` holds codes below 256."""
    rows, m = len(offsets) - 1, len(data) - n + 1
    if m <= 0:
        return np.zeros((rows, dim), np.float32)
    h = np.zeros(m, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + data[k : k + m] + np.uint32(1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(32 - dim.bit_length() + 1)
    key = np.repeat(np.arange(rows, dtype=np.int64) * dim, np.diff(offsets))[:m] + h
    ok = np.ones(m, bool)
    for e in range(1, n):
        at = offsets[1:-1] - e
        ok[at[(at >= 0) & (at < m)]] = False
    return np.bincount(key[ok], minlength=rows * dim).reshape(rows, dim).astype(np.float32)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold at most so many rows from now on, which bounds what a Python worker holds."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows or int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of this machine only where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            at = kept.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="metricmart-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{at.rstrip('/')}/metricmart-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage and outlives executors."""
    at = shared_folder(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
