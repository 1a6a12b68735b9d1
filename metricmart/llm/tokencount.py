"""Token counts of flat, unindexed token files (operator 10).

A token file holds 16-bit ids of documents, each followed by an end-of-document id, and nothing else. Files are read
in blocks of a fixed number of ids, each a row of its own: a vectorised search finds the end ids of a block, and gives
the block's whole documents, its ids before the first end and after the last. What a block leaves open is carried into
the next by a prefix scan over the blocks' summaries: within spans of ``span`` blocks, then over the spans.

Empty files give no rows; ids after a file's last end id are a document of their own, marked not closed. Documents
never reach over files. Beside each token file stands a manifest, written by the same task, that names its documents
in order, so every count leads back to its doc_id (null if that is null).

Null and empty texts have no tokens and are one end id; repeated rows count each on its own; texts are encoded whole.
Strings like ``<|endoftext|>`` in a text are encoded as text, since the end id may not stand in a document. Columns
other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricmart.llm import kernel
from metricmart.llm.kernel import shared_folder, stored
from metricmart.llm.tokens import ChunkEncoder, default_tokenizer

END_ID = 49407


def write_token_files(docs: DataFrame, at: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of each partition's texts (null: empty) as one flat file under ``kind=ids``, and their doc_ids, in
    the same order and as text, as one under ``kind=docs``; no shuffle.

    Spark's text writer puts a separator after each row; here rows are raw ids and the separator is the end id. The
    two files of a task have the same name, and both are written at once, so that rows keep their order.
    """
    path, end = tokenizer or default_tokenizer(), int(end_id).to_bytes(2, "little").decode("latin-1")
    spark = docs.sparkSession
    kernel.small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, special=False)
        for batch in batches:
            names = pc.fill_null(batch.column(0).cast(pa.string()), "").cast(pa.binary())
            for row, ids, ends in encoder.encode(batch.column(1)):
                raw, n = ids.astype("<u2").tobytes(), len(ends) - 1
                kinds = pa.array(["ids"] * n + ["docs"] * n)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([raw[2 * a : 2 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()), names.slice(row, n)]), kinds], names=["ids", "kind"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, "ids binary, kind string")
    writers = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")  # else rows are sorted by kind first
    try:
        rows.select(F.col("ids").cast("string"), "kind").write.partitionBy("kind").option("encoding", "ISO-8859-1").option("lineSep", end).text(at)
    finally:
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", writers)


def read_manifest(spark: SparkSession, at: str, end_id: int = END_ID) -> DataFrame:
    """file, doc_index, doc_id of all documents in the files under ``at``; a manifest holds one task's documents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{at}/kind=docs").where("length > 0")
    low, high = int(end_id).to_bytes(2, "little")
    names = F.split(F.decode("content", "ISO-8859-1"), f"\\x{low:02x}\\x{high:02x}")
    names = F.slice(names, F.lit(1), F.size(names) - 1)  # what follows the last separator is nothing
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(names)).select("file", F.col("pos").cast("long").alias("doc_index"), F.expr("try_cast(col as bigint)").alias("doc_id"))


def scan_token_files(spark: SparkSession, at: str, end_id: int = END_ID, block: int = 1 << 20, span: int = 1024) -> DataFrame:
    """file, doc_index (from 0 in the file), n_tokens (without the end id), closed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).where("length > 0").select("path", "length")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0), F.expr(f"(length - 1) div {2 * block}"))).alias("block"), "length").repartition("path", "block")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path, k, length in pdf.itertuples(index=False):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(2 * block, length - 2 * block * k), 2 * block * k), "<u2")
                ends = np.flatnonzero(ids == end_id)
                inner = np.diff(ends) - 1 if len(ends) else ends
                yield pd.DataFrame({"path": [path], "block": [k], "n_ends": [len(ends)], "head": [int(ends[0]) if len(ends) else len(ids)], "tail": [int(len(ids) - 1 - ends[-1]) if len(ends) else len(ids)], "inner": [inner.astype(np.int64)], "last": [bool(2 * block * (k + 1) >= length)]})

    found = blocks.mapInPandas(scan, "path string, block long, n_ends long, head long, tail long, inner array<long>, last boolean")
    found = stored(found)
    # prefix scan in two levels: (ends so far, open ids at the end) is associative; only the summaries go through it
    summary = found.drop("inner").withColumn("span", F.expr(f"block div {span}"))
    in_span = Window.partitionBy("path", "span").orderBy("block")
    before = in_span.rowsBetween(Window.unboundedPreceding, -1)
    reset = F.sum("n_ends").over(in_span)  # blocks with the same number of ends so far share what is open
    summary = summary.withColumn("ends_to", reset).withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    in_run = Window.partitionBy("path", "span", "ends_to").orderBy("block")
    summary = summary.withColumn("open_to", F.sum("tail").over(in_run))
    summary = summary.withColumn("open_before", F.coalesce(F.lag("open_to").over(in_span), F.lit(0)))
    spans = summary.groupBy("path", "span").agg(F.sum("n_ends").alias("s_ends"), F.max_by("open_to", "block").alias("s_open"))
    over = Window.partitionBy("path").orderBy("span")
    spans = spans.withColumn("s_to", F.sum("s_ends").over(over)).withColumn("carry_ends", F.coalesce(F.sum("s_ends").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.withColumn("s_open_to", F.sum("s_open").over(Window.partitionBy("path", "s_to").orderBy("span"))).withColumn("carry_open", F.coalesce(F.lag("s_open_to").over(over), F.lit(0)))
    rows = summary.join(spans.select("path", "span", "carry_ends", "carry_open"), ["path", "span"]).join(found.select("path", "block", "inner"), ["path", "block"])
    # what is open before a block reaches into its span's past only if an end lies there
    open_ids = F.col("open_before") + F.when(F.col("ends_before") == 0, F.col("carry_open")).otherwise(F.lit(0))
    doc = lambda n, closed: F.struct(n.alias("n_tokens"), F.lit(closed).alias("closed"))
    none = F.array().cast("array<struct<n_tokens:bigint,closed:boolean>>")
    first = F.when(F.col("n_ends") > 0, F.array(doc(F.col("head") + open_ids, True))).otherwise(none)
    inner = F.transform("inner", lambda n: doc(n, True))
    still_open = F.col("tail") + F.when(F.col("n_ends") == 0, open_ids).otherwise(F.lit(0))
    left_over = F.when(F.col("last") & (still_open > 0), F.array(doc(still_open, False))).otherwise(none)
    docs = rows.select("path", (F.col("carry_ends") + F.col("ends_before")).alias("before"), "block", F.posexplode(F.concat(first, inner, left_over)).alias("k", "doc"))
    return docs.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("before") + F.col("k")).alias("doc_index"), F.col("doc.n_tokens").alias("n_tokens"), F.col("doc.closed").alias("closed"))


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, closed of each document, counted in flat token files that are written to the shared folder."""
    at, spark = shared_folder(docs.sparkSession), docs.sparkSession
    write_token_files(docs, at, tokenizer)
    if not docs.take(1):
        return spark.createDataFrame([], "doc_id long, n_tokens long, closed boolean")
    counts = scan_token_files(spark, f"{at}/kind=ids")
    return counts.join(read_manifest(spark, at), ["file", "doc_index"], "left").select("doc_id", "n_tokens", "closed")
