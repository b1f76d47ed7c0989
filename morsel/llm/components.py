"""Connected components by alternating large-star and small-star steps (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morsel.llm.common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of every vertex of edges (a, b); group_id is the least vertex of the component.

    Each round writes its edges to the shared folder, so lineage stays short and a lost executor costs a task. The rounds
    needed grow with the logarithm of the vertices; edges are never more than at the start.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    last, k = None, 0
    while True:
        # large star: every neighbour that is greater is linked to the least of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the vertex itself, is linked to the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        e = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        e = scratch.write(e, f"edges{k}")
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if k:
            scratch.drop(f"edges{k - 1}")
        if sign == last:
            break
        last, k = sign, k + 1
    return e.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id")).unionByName(e.select(F.col("b").alias("doc_id"), F.col("b").alias("group_id")).distinct())
