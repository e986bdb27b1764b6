"""Identities of sources, chunks and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filing_source_id(ticker: Column, doc_type: Column, filed: Column, accession: Column) -> Column:
    key = F.md5(F.concat(ticker, filed.cast("string"), accession).cast("binary"))
    return F.concat_ws("_", F.lower(ticker), F.lower(F.replace(doc_type, F.lit("-"), F.lit(""))), F.substring(key, 1, 8))


def article_source_id(ticker: Column, url: Column) -> Column:
    return F.concat_ws("_", F.lower(ticker), F.lit("news"), F.substring(F.md5(url.cast("binary")), 1, 8))


def chunk_id(source_id: Column, version: str, index: Column) -> Column:
    return F.concat_ws("_", source_id, F.lit(version), F.lpad(index.cast("string"), F.greatest(F.lit(4), F.length(index.cast("string"))), F.lit("0")))


def parsed_chunk_id(column: str) -> list[Column]:
    """source_id, version (ch1 where an old id has none) and index of a chunk id."""
    whole = r"^(.*?)(?:_(ch[0-9]+))?_([0-9]+)$"
    part = lambda k: F.regexp_extract(column, whole, k)
    return [part(1).alias("source_id"), F.when(part(2) == "", "ch1").otherwise(part(2)).alias("version"), F.expr(f"try_cast(regexp_extract({column}, r'{whole}', 3) as bigint)").alias("chunk_index")]


def filing_url(cik: Column, accession: Column) -> Column:
    bare = F.replace(accession, F.lit("-"), F.lit(""))
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(cik, F.lit("0")), F.lit("/"), bare, F.lit("/"), accession, F.lit("-index.htm"))


def digest(df: DataFrame, key: str, columns: list[str], prefix: str) -> DataFrame:
    """One row: a digest of the whole table that no order of rows changes: sha256 over sorted lines, its first 16 digits.

    Rows are first digested in 65536 groups of the key's md5, so no task gathers more than a group.
    """
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    lines = df.select(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 4).alias("part"), F.sha2(line, 256).alias("line"))
    parts = lines.groupBy("part").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "\n")
    return parts.agg(F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 16)).alias("digest"))
