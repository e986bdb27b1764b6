"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import jaccard, media, mixing, pieces, pii, quality, suffixes, token_files, toxicity, winnowing
from docloom.llm.common import documents, fold, fresh_path
from docloom.llm.oracles import ORACLE_SQL as ORACLE_SQL

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "digest", "shard", "offset", "width", "height", "depth",
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def _scored(docs: DataFrame, score: Column, threshold: float) -> DataFrame:
    scores = docs.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score.alias("score"))
    return scores.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(docs, toxicity.score_column(toxicity.train(docs, labels(spark, sf_dir))), 0.5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_by_document(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), scores.alias("scores"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _scored(docs, quality.score_column(quality.train(docs, labels(spark, sf_dir))), 0.3)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, n: a + n)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_files.write(documents(spark, sf_dir), path, "word", pieces.read_model(WORD_MODEL), end_id=1)
    found = token_files.with_starts(token_files.checksums(token_files.read(spark, path)))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(PIECE_MODEL)
    both = pieces.decode(pieces.encode(documents(spark, sf_dir), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.compare_with_edits(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        winnowing.written("fingerprint").alias("fingerprint"),
        winnowing.written("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    "op1_media": op1_media,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_repeats": op6_repeats,
    "op7_token_files": op7_token_files,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_winnowing": op9_winnowing,
    "op10_jaccard_join": op10_jaccard_join,
}
