"""Joining keyword and vector results: normalisation, weighted outer merge, pools in order of priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(score: str, by: str) -> Column:
    """Scores scaled to 0 to 1 within by; where all are equal, 1."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))


def merge(dense: DataFrame, sparse: DataFrame, by: str = "query_id", dense_weight: float = 0.6, sparse_weight: float = 0.4) -> DataFrame:
    """(by, doc_id, dense, sparse, hybrid): full outer join of both sides' scaled scores; a missing side is 0."""
    d = dense.select(by, "doc_id", min_max("score", by).alias("dense"))
    s = sparse.select(by, "doc_id", min_max("score", by).alias("sparse"))
    both = d.join(s, [by, "doc_id"], "full_outer").na.fill(0.0, ["dense", "sparse"])
    return both.withColumn("hybrid", F.lit(dense_weight) * F.col("dense") + F.lit(sparse_weight) * F.col("sparse"))


def pool(lists: list[DataFrame], known: DataFrame, top_k: int) -> DataFrame:
    """Lists (doc_id, score) one after the other, each id and each text once, unknown ids dropped.

    All lists but the last are taken whole; room is for as many rows as those have, and top_k more. known has doc_id
    and content_hash; blank hashes never stand for one another.
    """
    tagged = [df.select("doc_id", "score").withColumn("stage", F.lit(k)) for k, df in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, tagged).join(known.select("doc_id", "content_hash"), "doc_id")
    order = [F.col("stage"), F.col("score").desc(), F.col("doc_id")]
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = rows.withColumn("n", first("doc_id")).where("n = 1")
    own = F.when(F.col("content_hash") == "", F.concat(F.lit("id:"), F.col("doc_id"))).otherwise(F.col("content_hash"))
    rows = rows.withColumn("own", own).withColumn("n", first("own")).where("n = 1")
    last = F.col("stage") == len(lists) - 1
    before = rows.where(~last)
    room = top_k + (sum(df.count() for df in lists[:-1]) - before.count() if len(lists) > 1 else 0)
    rest = rows.where(last).orderBy(*order).limit(room)
    return (before.union(rest) if len(lists) > 1 else rest).orderBy(*order).select("stage", "doc_id", "score")


def diagnostics(merged: DataFrame, by: str = "query_id") -> DataFrame:
    """For each query: hits of each side, of both, and the mode."""
    return merged.groupBy(by).agg(
        F.count_if(F.col("has_dense")).alias("dense_hits"),
        F.count_if(F.col("has_sparse")).alias("sparse_hits"),
        F.count_if(F.col("has_dense") & F.col("has_sparse")).alias("overlap"),
        F.when(F.count_if(F.col("has_dense")) > 0, "hybrid").otherwise("sparse_only").alias("mode"),
    )


def evidence(ranked: DataFrame, top_k: int, table_slots: int, by: str = "query_id", order: str | None = None) -> DataFrame:
    """The best table_slots tables and prose for the rest of top_k, in order of rank; ranked has by, doc_id, is_table, score, and order if that isn't by score."""
    lane = Window.partitionBy(by, "is_table").orderBy(*([order] if order else [F.col("score").desc(), "doc_id"]))
    t = ranked.withColumn("place", F.row_number().over(lane))
    tables = F.sum(F.when(F.col("is_table") & (F.col("place") <= table_slots), 1).otherwise(0)).over(Window.partitionBy(by))
    t = t.withColumn("quota", F.when(F.col("is_table"), F.lit(table_slots)).otherwise(F.lit(top_k) - tables))
    return t.where(F.col("place") <= F.col("quota")).select(by, "doc_id", "is_table", "score")
