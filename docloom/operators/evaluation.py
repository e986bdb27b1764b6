"""Measures of rankings, classifications and returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking(judged: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query_id, reciprocal_rank, hit_at_k, ndcg_at_k) from judged (query_id, doc_id, rank) and relevant (query_id, doc_id)."""
    marked = judged.join(relevant.distinct().withColumn("rel", F.lit(1)), ["query_id", "doc_id"], "left").na.fill(0, ["rel"])
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    t = marked.groupBy("query_id").agg(
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        *(F.max(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).cast("double").alias(f"hit_at_{k}") for k in ks),
        *(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_at_{k}") for k in ks),
        *(F.count_if(F.col("rank") <= k).alias(f"seen_{k}") for k in ks),
    )
    t = t.join(relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant")), "query_id", "left").na.fill(0, ["n_relevant"])
    for k in ks:
        most = F.least(F.col("n_relevant"), F.col(f"seen_{k}")).cast("int")
        ideal = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + F.lit(1)))
        t = t.withColumn(f"ndcg_at_{k}", F.when(ideal > 0, F.col(f"dcg_at_{k}") / ideal).otherwise(0.0))
    return t.drop(*(f"dcg_at_{k}" for k in ks), *(f"seen_{k}" for k in ks), "n_relevant")


RANKINGS = {"sparse": (0.0, 1.0), "dense": (1.0, 0.0), "hybrid": (0.6, 0.4)}


def four_way(merged: DataFrame, reranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(ranking, queries, mrr, hit_at_10, ndcg_at_10): means of three weightings of merged (query_id, doc_id, dense, sparse) and of reranked (query_id, doc_id, score).

    Only queries with relevant documents count; one that a ranking returns nothing for counts as 0.
    """
    asked = relevant.select("query_id").distinct()
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    lists = {name: merged.select("query_id", "doc_id", (F.lit(d) * F.col("dense") + F.lit(s) * F.col("sparse")).alias("score")) for name, (d, s) in RANKINGS.items()}
    out = None
    for name, scored in (lists | {"reranked": reranked.select("query_id", "doc_id", "score")}).items():
        judged = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
        each = asked.join(ranking(judged, relevant, (k,)), "query_id", "left").na.fill(0.0)
        row = each.agg(F.lit(name).alias("ranking"), F.count("*").alias("queries"), F.avg("reciprocal_rank").alias("mrr"), F.avg(f"hit_at_{k}").alias(f"hit_at_{k}"), F.avg(f"ndcg_at_{k}").alias(f"ndcg_at_{k}"))
        out = row if out is None else out.unionByName(row)
    return out


def f1(true: Column, predicted: Column, label: str) -> Column:
    """F1 of one label as an aggregate; 0 where it is not defined."""
    hit = F.count_if((true == label) & (predicted == label))
    said, there = F.count_if(predicted == label), F.count_if(true == label)
    return F.when(said + there > 0, 2 * hit / (said + there)).otherwise(0.0)


def macro_f1(true: Column, predicted: Column, labels: tuple[str, ...]) -> Column:
    total = f1(true, predicted, labels[0])
    for label in labels[1:]:
        total = total + f1(true, predicted, label)
    return total / len(labels)


def forward_return(prices: DataFrame, by: str, day: str, price: str, steps: int = 5) -> DataFrame:
    """Adds forward: the relative change to the price so many rows later, null where there is none."""
    later = F.lead(price, steps).over(Window.partitionBy(by).orderBy(day))
    return prices.withColumn("forward", F.bround((later - F.col(price)) / F.col(price), 4))


def first_within(events: DataFrame, calendar: DataFrame, days: int = 5) -> DataFrame:
    """Events (event_id, day) with the first calendar day from their day to so many days later.

    An equi-join on each of the few days allowed, not a range join.
    """
    probes = events.select("event_id", F.explode(F.sequence(F.col("day"), F.date_add("day", days))).alias("calendar_day"))
    hits = probes.join(calendar.select(F.col("day").alias("calendar_day")).distinct(), "calendar_day").groupBy("event_id").agg(F.min("calendar_day").alias("trading_day"))
    return events.join(hits, "event_id", "left")


def sharpe(signed: Column) -> Column:
    """Mean over sample deviation as an aggregate; null for fewer than two values or no variance."""
    spread = F.stddev_samp(signed)
    return F.when((F.count(signed) >= 2) & (spread > 0), F.avg(signed) / spread)


def percentiles(value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> list[Column]:
    """Exact percentiles by linear interpolation; 0 without values."""
    return [F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0)).alias(f"p{round(p * 100)}") for p in at]
