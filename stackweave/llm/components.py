"""Connected components of an edge table, by repeated large-star and small-star steps (Kiveris et al., 2014).

Edges never leave Spark. A hot node's neighbours are reduced by a grouped minimum before its edges are relabelled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stackweave.llm.common import stored


def _relink(edges: DataFrame, large: bool) -> DataFrame:
    """Every node tells its larger (large) or all other smaller (small) neighbours the smallest of its neighbourhood."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    told = both.join(low, "a")
    if large:
        return told.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return told.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        low.filter("a != m").select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.min("a")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) but the roots themselves; root is the smallest node reached."""
    edges = stored(edges.filter("a != b").select("a", "b").distinct())
    state = _state(edges)
    while True:
        edges = stored(_relink(_relink(edges, True), False))
        now = _state(edges)
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
