"""Bounded samples of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int, doc_id: str = "doc_id", text: str = "text", share: int = 20) -> tuple[list[str], list[int]]:
    """At most max_rows whole labelled texts of at most max_chars together, in order of the ids' md5; fold 0 stays out.

    A text of over a share-th of max_chars is left out and the next taken, so a few huge texts can't fill the sample.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
        .withColumn("key", F.md5(F.col("doc_id").cast("string").cast("binary")))
        .orderBy("key", "label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # The chosen ids are bounded by max_rows, so is what is broadcast.
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("n", F.length("text")).where(F.col("n") <= max_chars // share)
    so_far = Window.orderBy("key", "n").rowsBetween(Window.unboundedPreceding, 0)
    short = rows.select("key", "n").orderBy("key", "n").limit(max_rows).withColumn("sum", F.sum("n").over(so_far)).where(F.col("sum") <= max_chars)
    last = short.agg(F.max("key")).first()[0]
    if last is None:
        return [], []
    got = rows.where(F.col("key") <= last).orderBy("key", "n").select("text", "label").limit(max_rows).collect()
    return [r[0] for r in got], [r[1] for r in got]
