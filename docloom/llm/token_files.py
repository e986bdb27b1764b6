"""Token ids as Parquet list columns: dictionary or delta encoded, row groups of a set size, page indexes.

Files hold documents in ascending order of their ids, each file one range of them and about FILE_BYTES of
text, so a reader fetches metadata without tokens (read_metadata), or the tokens of a few documents by column
and page (read_some), without reading the rest. Ids come from a distinct-chunk table (see chunks); texts are
dealt by ranges of doc_id before they are encoded, so each is encoded once. Nulls are empty texts (the end id
alone); a text of any length is one row; rows without an id come first; rows that repeat an id are kept each,
in order of their texts, equal ones in any order; an empty table writes no rows and reads back as none;
columns other than id and text are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import chunks
from docloom.llm.common import materialize

ROW_GROUP_BYTES = 8 << 20
PAGE_BYTES = 256 << 10
FILE_BYTES = 64 << 20


def write(docs: DataFrame, path: str, kind: str, model: bytes, end_id: int, dictionary: bool = True, row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES) -> None:
    """Writes (doc_id, n_tokens, ids); without a dictionary, ids are delta encoded.

    Files are as many as the texts' bytes ask for, and at least as many as the session deals shuffles to.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    dealt = texts.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = chunks.encode(dealt, kind, model, end_id).select("doc_id", F.size("ids").alias("n_tokens"), "ids")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.enable.dictionary": str(dictionary).lower(), "parquet.writer.version": "v2", "parquet.dictionary.page.size": 1 << 20}
    encoded.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, file, row): documents with their file and place in it."""
    return spark.read.parquet(path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens) from their own column chunks: the tokens' are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_some(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of the given documents, a list of bounded size: row groups and pages without them are skipped by their indexes."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, file, row, n_tokens, ids_crc32) of the ids as little-endian 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = lists.offsets.to_numpy()
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            sums = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids", "file", "row").mapInArrow(run, f"doc_id {kind}, file string, row long, n_tokens long, ids_crc32 long")


def with_starts(measured: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before: sums within each file, and of the files before it.

    Files are as many as ranges were dealt; only their totals meet in one window.
    """
    measured = materialize(measured, "token-sums")
    files = measured.groupBy("file").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    so_far = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return measured.withColumn("within", F.coalesce(F.sum("n_tokens").over(so_far), F.lit(0))).join(files, "file").withColumn("start", F.col("base") + F.col("within"))
