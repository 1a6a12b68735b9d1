"""Folds of documents by the CRC-32 of their id as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_out(parts: int, part: int, doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))
