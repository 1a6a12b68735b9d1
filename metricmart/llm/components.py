"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm.kernel import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b. Returns node, component (the smallest node that it reaches), for nodes with an edge.

    Each step is a minimum by vertex (pre-aggregated) joined back to the edges, so a vertex with very many edges
    is one aggregate row and a join that adaptive execution can split. Each round is written to the shared folder.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:  # the steps converge in a logarithmic number of rounds
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: all edges point down (u > v)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(least).where("u <> v").distinct().toDF("a", "b"))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy("a").agg(F.min("b").alias("b")).union(e.select("b", "b").distinct()).toDF("node", "component")
