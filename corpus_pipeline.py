"""A corpus pipeline of five stages, each written as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents, extra ones included, whatever these are named. No stage reads prefixes, samples or caps
rows (the classifier is fitted on a bounded sample of labelled rows); an empty table passes through all as one.
What a stage writes on its way is dropped when its result is written, and that when the next one's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard, mixing, pieces, pii, toxicity
from docloom.llm.common import MayBeAmong, documents, drop, fresh_path, scratch
from docloom.llm.queries import PIECE_MODEL

TOXIC = 0.5
MIX = mixing.Mix(share_of=4, share_in=5, epochs=1)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on a bounded labelled sample of them, rejects are left out.

    Null and empty texts and rows without an id are scored like others and stay, as the intercept is below TOXIC
    where toxic rows are the fewer; repeated rows share one fate; a score of exactly TOXIC is rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score_column(model) < TOXIC)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked documents the one with the smallest id stays.

    Texts without words (null ones too) link with nothing and stay, as do rows without an id; rows that repeat an id
    are one document (see jaccard) and stay or go together. Only texts that may be among those that go are dealt.
    """
    others = jaccard.near_duplicates(docs).where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    may_go = MayBeAmong(others).column(F.col("doc_id"))
    return docs.where(~may_go).union(docs.where(may_go).join(others, "doc_id", "left_anti").select(docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to the names of their kinds; no row goes.

    Null texts stay null, empty ones empty; n_chars, where the table has it and it isn't null, is the new text's length;
    repeated rows and rows without an id are redacted each; of overlapping spans the longest, then the first kind, gives the name.
    """
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch's prefixes of each leaf, to the target weights: documents that a leaf's prefix reaches stay, whole.

    Null and empty texts and those of blanks alone have no tokens, so no prefix reaches them and they go; null languages
    and sources are a leaf of their own; rows that repeat an id and text stand at one place and stay or go together.
    """
    return mixing.choose_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): piece ids with an end id, one row for each row; null and empty texts have the end id alone."""
    encoded = pieces.encode(docs, pieces.read_model(PIECE_MODEL))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Classification and piece segmentation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
