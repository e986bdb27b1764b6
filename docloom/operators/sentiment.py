"""Point-in-time, recency-weighted sentiment of every entity at once.

Evidence is chunks with entity, source_id, chunk_id, chunk_index, section, attribution, date and their
scores (score, confidence, reliable). Documents are as new as their newest eligible chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Eligible attributions, freshness, half-life, how many documents and chunks count, sections by preference.
ELIGIBLE = ("filer", "news_title")
FRESH_DAYS, HALF_LIFE, DOCUMENTS, CHUNKS = 30, 7.0, 8, 2
SECTIONS = ("item_7", "item_2", "item_1a")


def section_rank(section: str | Column) -> Column:
    out = F.lit(9)
    for k in reversed(range(len(SECTIONS))):
        out = F.when((F.col(section) if isinstance(section, str) else section) == SECTIONS[k], k).otherwise(out)
    return out


def document_id(source_id: str = "source_id", chunk_id: str = "chunk_id") -> Column:
    """A chunk's document: its source, or, where that is blank, what its id names before version and index."""
    named = F.regexp_extract(F.col(chunk_id).cast("string"), r"^(.*?)(?:_(?:ch[0-9]+))?_t?[0-9]+$", 1)
    return F.coalesce(F.nullif(F.col(source_id), F.lit("")), F.nullif(named, F.lit("")), F.col(chunk_id).cast("string"))


def eligible(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("source_id", document_id()).where(F.col("attribution").isin(*ELIGIBLE) & ~F.coalesce(F.col("section"), F.lit("")).endswith("_table"))


def documents_of(chunks: DataFrame) -> DataFrame:
    """Chunks with doc_date, the newest date of their document."""
    return chunks.withColumn("doc_date", F.max("date").over(Window.partitionBy("entity", "source_id")))


def picked(chunks: DataFrame, as_of: Column, documents: int = DOCUMENTS, per_document: int = CHUNKS) -> DataFrame:
    """Fresh documents' best chunks: the newest documents of each entity, then chunks by section and index."""
    dated = documents_of(eligible(chunks)).where(F.col("doc_date").between(F.date_sub(as_of, FRESH_DAYS), as_of))
    newest = dated.withColumn("doc_rank", F.dense_rank().over(Window.partitionBy("entity").orderBy(F.col("doc_date").desc(), "source_id"))).where(F.col("doc_rank") <= documents)
    best = Window.partitionBy("entity", "source_id").orderBy(section_rank("section"), "chunk_index", "chunk_id")
    return newest.withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_document)


def document_signals(scored: DataFrame, as_of: Column, half_life: float = HALF_LIFE) -> DataFrame:
    """(entity, source_id, doc_date, score, confidence, weight) over reliable chunks."""
    total = F.sum("confidence")
    t = scored.where("reliable").groupBy("entity", "source_id", "doc_date")
    t = t.agg(F.when(total > 0, F.sum(F.col("score") * F.col("confidence")) / total).otherwise(F.avg("score")).alias("score"), F.avg("confidence").alias("confidence"))
    return t.withColumn("weight", F.col("confidence") * F.pow(F.lit(0.5), F.date_diff(as_of, F.col("doc_date")) / half_life))


def entity_scores(signals: DataFrame) -> DataFrame:
    """(entity, score, confidence, documents): weighted mean of documents; without weight, the mean of rounded signals."""
    weight = F.sum("weight")
    score = F.when(weight > 0, F.sum(F.col("weight") * F.col("score")) / weight).otherwise(F.avg(F.bround("score", 4)))
    return signals.groupBy("entity").agg(score.alias("score"), F.avg("confidence").alias("confidence"), F.count("*").alias("documents"))


def status(chunks: DataFrame, as_of: Column) -> DataFrame:
    """(entity, status, reason, last_document_date, documents_used, reliable_chunks, total_chunks) by what evidence there is.

    no_data without any eligible chunk; stale without a fresh document; of the chunks that are picked for scoring,
    degraded if none is reliable (full_extraction_failure) or some aren't (partial_extraction_failure); else ok.
    chunks carry reliable; the last document date is the newest not after as_of, even when stale.
    """
    documents = eligible(chunks).groupBy("entity", "source_id").agg(F.max("date").alias("doc_date"))
    known = documents.groupBy("entity").agg(F.max(F.when(F.col("doc_date") <= as_of, F.col("doc_date"))).alias("last_document_date"), F.lit(True).alias("any"))
    good = F.col("reliable")
    # A document has few picked chunks, so it is counted where its chunks already meet.
    each = picked(chunks, as_of).groupBy("entity", "source_id").agg(F.count("*").alias("total"), F.count_if(good).alias("good"))
    used = each.groupBy("entity").agg(F.sum("total").alias("total"), F.sum("good").alias("good"), F.count_if(F.col("good") > 0).alias("used"))
    t = chunks.select("entity").distinct().join(known, "entity", "left").join(used, "entity", "left")
    state = F.when(F.col("any").isNull(), "no_data").when(F.col("total").isNull(), "stale").when(F.col("good") < F.col("total"), "degraded").otherwise("ok")
    reason = F.when(F.col("good") == 0, "full_extraction_failure").when(F.col("good") < F.col("total"), "partial_extraction_failure")
    count = lambda c, n: F.coalesce(F.col(c), F.lit(0)).alias(n)
    return t.select("entity", state.alias("status"), reason.alias("reason"), "last_document_date", count("used", "documents_used"), count("good", "reliable_chunks"), count("total", "total_chunks"))


def summary(signals: DataFrame) -> DataFrame:
    """(entity, average, trend, period_days, documents): trend by the newest three against the mean."""
    newest = Window.partitionBy("entity").orderBy(F.col("doc_date").desc(), "source_id")
    t = signals.withColumn("n", F.row_number().over(newest)).groupBy("entity")
    t = t.agg(F.avg("score").alias("average"), F.avg(F.when(F.col("n") <= 3, F.col("score"))).alias("recent"), F.date_diff(F.max("doc_date"), F.min("doc_date")).cast("long").alias("period_days"), F.count("*").alias("documents"))
    trend = F.when(F.col("documents") < 3, "stable").when(F.col("recent") > F.col("average") + 0.1, "improving").when(F.col("recent") < F.col("average") - 0.1, "declining").otherwise("stable")
    return t.select("entity", "average", trend.alias("trend"), "period_days", "documents")


def coverage(chunks: DataFrame, by: list[str], date: str) -> DataFrame:
    """First and last date, years covered, and years missing between them."""
    t = chunks.groupBy(*by).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.sort_array(F.collect_set(F.year(date))).alias("years"))
    return t.withColumn("missing", F.array_except(F.sequence(F.year("first_date"), F.year("last_date")), "years"))


def predicted_label(scores: DataFrame, edge: float = 0.1) -> DataFrame:
    """(entity, label): positive or negative beyond the edge, else neutral; unavailable without a score."""
    s = F.col("score")
    return scores.select("entity", F.when(s.isNull() | F.isnan(s), "unavailable").when(s > edge, "positive").when(s < -edge, "negative").otherwise("neutral").alias("label"))
