"""Connected components of a table of links, by alternating stars; no link or label goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import drop, spread_join, written


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones.
    Minima are combined before they are shuffled, and joins with them spread a node's links over tasks, so
    a node with many links is no burden. Stars need about log(nodes) rounds; if so many rounds as given don't
    settle the links, this raises and returns nothing unfinished.
    """
    spark = links.sparkSession
    edges, at = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = spread_join(both.where("y > x"), low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where(F.col("x") != F.col("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = spread_join(large, least, "x").where(F.col("y") != F.col("m")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        edges, to = written(small.union(least.select("x", F.col("m").alias("y"))).distinct(), "links")
        drop(spark, at)
        at = to
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("x").agg(F.min("y").alias("component")).withColumnRenamed("x", "node").union(edges.select("y", "y").distinct())
        before = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")
