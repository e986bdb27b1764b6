"""Keeping a corpus: caches, backfills, frozen versions, index rebuilds and reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import ids
from docloom.functions.text import attribution
from docloom.operators import store, vectors
from docloom.sources.filings import header_dates, read_tree


@dataclass
class Cache:
    """Results by id and the hash of what they were made from (embeddings, sentiment), as versions of a table."""

    spark: SparkSession
    root: str
    schema: str

    def load(self) -> DataFrame:
        """What is held; nothing if it is missing, has other columns or can't be read."""
        none = self.spark.createDataFrame([], self.schema)
        try:
            held = store.Store(self.spark, self.root).read()
        except Exception:  # noqa: BLE001  a cache that can't be read is an empty one
            return none
        return held.select(none.columns) if held is not None and set(none.columns) <= set(held.columns) else none

    def save(self, rows: DataFrame) -> int:
        """Adds rows, which replace those of their ids; a crash leaves the version before."""
        return store.Store(self.spark, self.root).publish(store.upsert(self.load(), rows.select(self.load().columns), "id"), "id")

    def completed(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], cacheable: Column | None = None) -> DataFrame:
        """wanted (id, hash, ...) with the cached columns: hits of the same hash as they are, misses by make, which is saved where cacheable."""
        held = self.load()
        same = held.withColumnRenamed("hash", "held").join(wanted.select("id", "hash"), "id").where((F.col("held") != "") & (F.col("held") == F.col("hash")))
        hits = same.select(held.columns)
        made = make(wanted.join(hits.select("id"), "id", "left_anti")).select(held.columns)
        self.save(made.where(cacheable) if cacheable is not None else made)
        again = self.load().withColumnRenamed("hash", "held").join(wanted.select("id", "hash"), "id").where(F.col("held") == F.col("hash")).select(held.columns)
        return again if cacheable is None else again.unionByName(made.join(again.select("id"), "id", "left_anti"))


def header_sweep(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(accession, period_end) of filings below several roots; of one that several have, the first root's."""
    found = [read_tree(spark, r).select("accession", header_dates("text")[1], F.lit(k).alias("root")) for k, r in enumerate(roots)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    first = rows.where("period_end is not null").groupBy("accession").agg(F.min(F.struct("root", "period_end")).alias("best"))
    return first.select("accession", "best.period_end")


def backfill_periods(chunks: DataFrame, headers: DataFrame, key: str = "accession_number") -> DataFrame:
    """chunks with period_end from headers (key, found) where they have none; what they have stays."""
    return chunks.join(headers.select(key, "found"), key, "left").withColumn("period_end", F.coalesce("period_end", "found")).drop("found")


def missing_periods(chunks: DataFrame, by: str, key: str = "accession_number") -> DataFrame:
    """(by, filings, chunks): filings of which no chunk has a period."""
    each = chunks.groupBy(by, key).agg(F.count("period_end").alias("known"), F.count("*").alias("n"))
    return each.where("known = 0").groupBy(by).agg(F.count("*").alias("filings"), F.sum("n").alias("chunks"))


def backfill_attribution(chunks: DataFrame, of_first: Callable[[Column], Column], article: str, order: str, text: str = "text") -> DataFrame:
    """chunks with attribution: every article's is that of its first chunk's text."""
    first = chunks.groupBy(article).agg(F.min_by(text, order).alias("_first"))
    return chunks.join(first, article).withColumn("attribution", of_first(F.col("_first"))).drop("_first")


def mention_attribution(names: list[str]) -> Callable[[Column], Column]:
    """How an article names a company: in its title (the first chunk's text up to a full stop) or its body."""
    return lambda text: attribution(F.substring_index(text, ". ", 1), text, names)


def backfill_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """chunks (chunk_id, ...) with source_id, accession_number and attribution of the source that their id names, filings only.

    sources is (source_id, accession_number); what a chunk has stays, news is left alone.
    """
    named = ids.parsed_chunk_id("chunk_id")[0]
    known = sources.select(F.col("source_id").alias("_named"), F.col("accession_number").alias("_number"))
    t = chunks.withColumn("_named", F.when(F.col("doc_type") != "news", named)).join(known, "_named", "left")
    filled = lambda old, new: F.coalesce(F.nullif(F.col(old), F.lit("")), new, F.col(old)).alias(old)
    found = F.col("_number").isNotNull()
    made = {"source_id": F.when(found, F.col("_named")), "accession_number": F.col("_number"), "attribution": F.when(found, F.lit("filer"))}
    return t.select(*(filled(c, made[c]) if c in made else F.col(c) for c in chunks.columns))


def ingest_stats(chunks: DataFrame, by: str, source: str, date: str) -> DataFrame:
    """(by, chunks, sources, first, last)."""
    return chunks.groupBy(by).agg(F.count("*").alias("chunks"), F.count_distinct(source).alias("sources"), F.min(date).alias("first"), F.max(date).alias("last"))


def rebuild_report(held: DataFrame, rebuilt: DataFrame, chunks: DataFrame, least: float = 0.999) -> DataFrame:
    """One row: rebuilt vectors (id, hash, embedding) against chunks (id, hash) and, by cosine, against those that were held.

    reconcile's counts; compared, how many ids both indexes have; drifted, how many of these have a cosine below least;
    worst, the least cosine; and whether all is well.
    """
    counts = store.reconcile(rebuilt.select("id", "hash"), chunks)
    unit = lambda df, name: df.select("id", vectors.normalised("embedding").alias(name))
    both = unit(held, "u").join(unit(rebuilt, "v"), "id").select(vectors.inner("u", "v").alias("cosine"))
    drift = both.agg(F.count("*").alias("compared"), F.count_if(F.col("cosine") < least).alias("drifted"), F.min("cosine").alias("worst"))
    fine = (F.col("orphan_vectors") + F.col("without_vector") + F.col("mismatched") + F.col("unknown_hash") + F.col("drifted")) == 0
    return counts.crossJoin(drift).withColumn("verified_all", fine)


@dataclass
class Versions:
    """Frozen copies of a corpus, named by a digest of its chunks, which is checked whenever one is used."""

    spark: SparkSession
    root: str

    def describe(self, chunks: DataFrame) -> dict:
        """The version's name, and whether every vector was made from its chunk's text."""
        name = ids.digest(chunks, "chunk_id", ["chunk_id", "content_hash"], "cv-").first()[0]
        index = ids.digest(chunks.where("embedding is not null"), "chunk_id", ["chunk_id", "vector_hash"], "cv-").first()[0]
        return {"version": name, "consistent": name == index, "chunks": chunks.count()}

    def _store(self, name: str) -> store.Store:
        return store.Store(self.spark, f"{self.root}/{name}")

    def snapshot(self, chunks: DataFrame) -> str:
        """Writes a copy; one that is there already is verified instead."""
        info = self.describe(chunks)
        if not info["consistent"]:
            raise ValueError(f"vectors and texts of {info['version']} are not of one version")
        name = info["version"]
        if self._store(name).read() is None:
            self._store(name).publish(chunks, "chunk_id")
        if not self.verify(name):
            raise ValueError(f"{name} does not verify")
        return name

    def verify(self, name: str) -> bool:
        held = self._store(name).read()
        return held is not None and self.describe(held) == {"version": name, "consistent": True, "chunks": held.count()}

    def activate(self, name: str, target: store.Store, partition_by: list[str] | None = None) -> str:
        """Makes a verified copy the target's next version and returns the name of a copy of what it had before.

        If what was published doesn't verify, the target goes back to the version before.
        """
        if not self.verify(name):
            raise ValueError(f"{name} does not verify; nothing was changed")
        before = self.snapshot(target.read())
        if before != name:
            target.publish(self._store(name).read(), "chunk_id", partition_by)
            if self.describe(target.read())["version"] != name:
                target.rollback()
                raise RuntimeError(f"activation of {name} did not verify; {before} is current again")
        return before


def write_results(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, replacing what is there."""
    rows.write.mode("overwrite").json(path)


