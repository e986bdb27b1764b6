"""News entries, golden sets and prices from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import attribution
from docloom.sources.html import prose_column

LEAST_CHARS, MOST_ARTICLES, MOST_DAYS = 50, 50, 90


def articles(entries: DataFrame, names: list[str], now: str) -> DataFrame:
    """Feed entries (source, at, title, link, published, updated, summary, content, description) as articles.

    Undated or short entries are skipped; those older than MOST_DAYS or that name no one wanted are left out; a
    url counts once, in order of feeds; at most MOST_ARTICLES remain.
    """
    body = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("summary", "content", "description")))
    t = entries.withColumn("published", F.coalesce("published", "updated")).where("published is not null")
    t = t.withColumn("text", prose_column(F.coalesce(body, F.lit("")))).where(F.length("text") >= LEAST_CHARS)
    t = t.where(F.to_timestamp(F.to_date("published")) >= F.to_timestamp(F.lit(now)) - F.expr(f"interval {MOST_DAYS} days"))
    t = t.withColumn("attribution", attribution(F.col("title"), F.col("text"), names)).where("attribution is not null")
    first = Window.partitionBy("link").orderBy("source", "at")
    t = t.withColumn("n", F.row_number().over(first)).where("n = 1")
    return t.orderBy("source", "at").limit(MOST_ARTICLES).select("title", "text", F.to_date("published").alias("date"), F.col("link").alias("url"), "source", "attribution")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, relevant): entries with question or query; refuses entries without relevance and sets without any."""
    raw = spark.read.option("multiLine", "true").json(path)
    if "relevant_chunk_ids" not in raw.columns:
        raise ValueError("relevant_chunk_ids is missing")
    asked = [F.col(c) for c in ("question", "query") if c in raw.columns]
    t = raw.select("id", F.coalesce(*asked).alias("question"), F.col("relevant_chunk_ids").cast("array<string>").alias("relevant"))
    facts = t.agg(F.count("*").alias("n"), F.count_if(F.col("question").isNull() | F.col("relevant").isNull()).alias("bad"), F.count_if(F.size("relevant") > 0).alias("marked")).first()
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} of {facts['n']} entries are malformed")
    if facts["n"] and not facts["marked"]:
        raise ValueError("no entry is annotated")
    return t


#: Fixed value: days of prices beyond a period's end, so that returns of its last days have an end.
PRICE_DAYS = 14


def prices_between(raw: DataFrame, first: str, last: str) -> DataFrame:
    """prices() from first to PRICE_DAYS after last."""
    return prices(raw).where(F.col("date").between(F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), PRICE_DAYS)))


def prices(raw: DataFrame) -> DataFrame:
    """(ticker, date, close) without missing values."""
    return raw.where(F.col("close").isNotNull() & ~F.isnan("close")).select("ticker", F.to_date("date").alias("date"), F.col("close").cast("double").alias("close"))
