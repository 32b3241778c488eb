"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it reaches.

    Each round hangs a node's larger neighbours on its smallest neighbour (large star), then
    its smaller ones on the smallest (small star), until nothing changes. A node's minimum is
    a grouping with a map-side step, and attaching it is a join that Spark can split, so a
    node with very many links is no hot group. Each round's edges are written to the shared
    scratch folder. Loops and repeated edges are harmless.
    """
    spark = edges.sparkSession
    least, most = F.least("a", "b"), F.greatest("a", "b")
    now = written(edges.select(most.alias("a"), least.alias("b")).filter("a <> b").distinct(), scratch(spark, "edges"))
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(lowest.select("a", F.col("m").alias("b")))).distinct()
        now = written(small, scratch(spark, "edges"))
        shape = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if shape == before:
            break
        before = shape
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
