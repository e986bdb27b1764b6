"""The library's front: ingest documents, ask, and read sentiment, coverage and health, all as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import ids, periods
from docloom.functions.text import excerpt, fold_dashes
from docloom.models import Models
from docloom.operators import answers, bm25, fusion, rerank, sentiment, store, tables, vectors
from docloom.operators.chunking import Limits, chunked


@dataclass(frozen=True)
class Config:
    limits: Limits = Limits()
    version: str = "ch2"
    candidates: int = 50
    top_k: int = 5
    table_slots: int = 2
    period_candidates: int = 10
    reported_tables: int = 15
    dense_weight: float = 0.6
    sparse_weight: float = 0.4
    tickers: tuple[str, ...] = ()


def _is_table(chunks: DataFrame) -> Column:
    return F.coalesce(F.col("section"), F.lit("")).endswith("_table") if "section" in chunks.columns else F.lit(False)


@dataclass
class Engine:
    spark: SparkSession
    root: str
    config: Config = field(default_factory=Config)
    models: Models = field(default_factory=Models)

    @property
    def store(self) -> store.Store:
        return store.Store(self.spark, f"{self.root}/chunks")

    def ingest(self, documents: DataFrame) -> int:
        """Documents (ticker, doc_type, date, url, text, period_end, attribution): chunks replace all their source had; one new version is published.

        Unchanged texts keep their vectors. The numeric tables of a column html, if there is one, are chunks behind a
        source's prose; their section ends in _table.
        """
        c, held = self.config.limits, self.store.read()
        named = documents.withColumn("source_id", ids.article_source_id(F.col("ticker"), F.col("url")))
        if "section" not in named.columns:
            named = named.withColumn("section", F.lit(None).cast("string"))
        if held is not None and "section" not in held.columns:
            held = held.withColumn("section", F.lit(None).cast("string"))
        if held is not None and "vector_hash" not in held.columns:
            held = held.withColumn("vector_hash", F.lit("").cast("string"))
        facts = named.drop("text", "html")
        made = chunked(named, "source_id", "text", c.target, c.most, c.least, c.overlap)
        own = made.join(facts, "source_id")
        if "html" in named.columns:
            own = own.drop("total_chunks").unionByName(self._tables(named, made).join(facts.drop("section"), "source_id"))
            own = own.withColumn("total_chunks", F.count("*").over(Window.partitionBy("source_id")))
        made = own.withColumn("chunk_id", ids.chunk_id(F.col("source_id"), self.config.version, F.col("chunk_index")))
        made = made.withColumnRenamed("chunk", "text").withColumn("content_hash", F.sha2(F.col("text"), 256))
        if held is None:
            full = made.withColumn("embedding", self.models.embed(F.col("text"))).withColumn("vector_hash", F.col("content_hash"))
        else:
            known = held.select("chunk_id", F.col("content_hash").alias("held_hash"), F.col("embedding").alias("held_embedding"), F.col("vector_hash").alias("held_vector"))
            both = made.join(known, "chunk_id", "left")
            # A vector is kept if it was made from this very text.
            same = (F.col("held_hash") == F.col("content_hash")) & (F.col("held_vector") == F.col("content_hash"))
            hits = both.where(same).withColumn("embedding", F.col("held_embedding"))
            misses = both.where(~F.coalesce(same, F.lit(False))).withColumn("embedding", self.models.embed(F.col("text")))
            full = hits.unionByName(misses).withColumn("vector_hash", F.col("content_hash")).drop("held_hash", "held_embedding", "held_vector")
            gone = store.orphans(held.select("chunk_id", "source_id"), made.select("chunk_id"), named.select("source_id"))
            full = store.upsert(store.delete(held, gone, "chunk_id"), full, "chunk_id")
        return self.store.publish(full, "chunk_id", ["ticker"])

    def _tables(self, named: DataFrame, prose: DataFrame) -> DataFrame:
        """Chunks of the sources' numeric tables, with section; their numbers follow those of the prose."""
        context = F.concat_ws(" ", "ticker", "doc_type", F.concat(F.lit("period ended "), F.col("period_end").cast("string")))
        found = tables.extracted(named, "source_id", "html").join(named.select("source_id", context.alias("context")), "source_id")
        counts = prose.groupBy("source_id").agg((F.max("chunk_index") + 1).alias("n"))
        pages = tables.rendered(found, "source_id", "context", self.config.limits.most).join(counts, "source_id", "left")
        pages = pages.join(named.select("source_id", F.concat(F.coalesce("section", F.lit("filing")), F.lit("_table")).alias("section")), "source_id")
        index = (F.coalesce("n", F.lit(0)) + F.col("at")).cast(prose.schema["chunk_index"].dataType)
        return pages.select("source_id", "section", index.alias("chunk_index"), F.col("text").alias("chunk"))

    def chunks(self) -> DataFrame:
        found = self.store.read()
        if found is None:
            raise ValueError("nothing has been ingested")
        return found

    def query(self, question: str, ticker: str | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The evidence for a question: chunks with their scores, header and excerpt, best first."""
        if not 5 <= len(question) <= 500:
            raise ValueError("a question has 5 to 500 characters")
        if ticker is not None:
            self.checked_ticker(ticker)
        cfg, every = self.config, self.chunks()
        scope = every
        for value, rule in ((ticker, F.col("ticker") == ticker), (date_from, F.col("date") >= F.lit(date_from)), (date_to, F.col("date") <= F.lit(date_to))):
            scope = scope.where(rule) if value is not None else scope
        asked = self.spark.range(1).select(F.lit(0).alias("query_id"), periods.search_question(F.lit(question)).alias("query"))
        vector = asked.select("query_id", self.models.embed(F.col("query")).alias("query"))
        scores = bm25.scores(every, asked, "chunk_id")

        def search(some: DataFrame, k: int) -> DataFrame:
            # Only vectors that were made from the text as it stands are trusted.
            trusted = some.where(F.col("vector_hash") == F.col("content_hash"))
            near = vectors.search(trusted.select(F.col("chunk_id").alias("vec_id"), "embedding"), vector, k)
            dense = near.select("query_id", F.col("vec_id").alias("doc_id"), "score")
            sparse = bm25.top_k(scores.join(some.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_semi"), k).select("query_id", "doc_id", "score")
            merged = fusion.merge(dense, sparse, dense_weight=cfg.dense_weight, sparse_weight=cfg.sparse_weight)
            return merged.select("doc_id", F.col("hybrid").alias("score"))

        merged = search(scope, cfg.candidates)
        first = [] if ticker is None or date_from is not None or date_to is not None else self._of_period(question, scope, search)
        if first:
            merged = merged.join(scope.where(_is_table(scope)).select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_anti")
        texts = every.select(F.col("chunk_id").alias("doc_id"), "text", "content_hash", "ticker", "doc_type", "date", "period_end", _is_table(every).alias("is_table"))
        best = fusion.pool([*first, merged], texts, cfg.candidates)
        candidates = best.join(texts, "doc_id").select(F.lit(0).alias("query_id"), "doc_id", F.lit(question).alias("question"), "text")
        ranked = rerank.rerank(candidates, self.models.relevance).join(texts.drop("text"), "doc_id")
        chosen = fusion.evidence(ranked.withColumnRenamed("final_score", "score"), cfg.top_k, cfg.table_slots)
        header = periods.source_header(F.col("ticker"), F.col("doc_type"), F.lit(None).cast("struct<year:int,part:string>"), F.col("period_end"), F.col("date"))
        return chosen.join(texts.drop("is_table"), "doc_id").select("doc_id", "score", "is_table", header.alias("header"), excerpt("text").alias("excerpt")).orderBy(F.col("score").desc(), "doc_id")

    def checked_ticker(self, ticker: str) -> str:
        """One to five capitals, and one of the configured tickers where there are any."""
        if not re.fullmatch("[A-Z]{1,5}", ticker):
            raise ValueError("a ticker is one to five capital letters")
        if self.config.tickers and ticker not in self.config.tickers:
            raise LookupError(f"{ticker} is not configured")
        return ticker

    def answer(self, question: str, model: answers.Answerer = answers.extractive, **scope: str | None) -> tuple[DataFrame, DataFrame]:
        """The answer with its cited texts, and what of it the sources support; scope as in query()."""
        found = self.query(question, **scope)
        texts = self.chunks().select(F.col("chunk_id").alias("doc_id"), "ticker", "text", F.col("url").alias("source"))
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id"))  # top_k rows
        ranked = found.select("doc_id", "header", rank.alias("rank")).join(texts, "doc_id")
        evidence = ranked.select(F.lit(0).alias("query_id"), F.lit(question).alias("question"), "rank", "ticker", "header", "source", "text")
        asked = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(question).alias("question"))
        made = answers.answered(asked, evidence, model)
        return made, answers.supported(made)

    def _of_period(self, question: str, own: DataFrame, search: Callable[[DataFrame, int], DataFrame]) -> list[DataFrame]:
        """For a question that names fiscal periods, two lists (doc_id, score) from one ticker's chunks: prose of those periods' filings, and tables with a column for them.

        Where a period has no filing, the next year's stands for it, which reports it beside its own. The tables that
        state reported figures always come along. No lists if no period is named or the ticker's year end is unknown.
        """
        cfg = self.config
        ends = own.where("doc_type = '10-K'").agg(F.max("period_end")).first()[0]
        if ends is None:
            return []
        month, day = F.lit(ends.month), F.lit(ends.day)
        line = self.spark.range(1).select(periods.requested_periods(F.lit(question), month).alias("p"), periods.requested_bases(fold_dashes(F.lit(question))).alias("b")).first()
        asked = [(p.year, p.part) for p in line.p]
        if not asked:
            return []
        own = own.withColumn("label", periods.fiscal_label(F.col("doc_type"), F.col("period_end"), month, day))
        there = {(r.year, r.part) for r in own.where("label is not null").select("label.*").distinct().collect()}
        in_any = lambda some: reduce(or_, [(F.col("label.year") == y) & (F.col("label.part") == p) for y, p in sorted(some)], F.lit(False))
        want = {(y, p) if (y, p) in there else (y + 1, p) for y, p in asked}
        best = lambda df, k: df.orderBy(F.col("score").desc(), "doc_id").limit(k)
        prose = best(search(own.where(in_any(want) & ~_is_table(own)), cfg.period_candidates), cfg.period_candidates)

        headings = F.regexp_extract("text", r"(?m)^Columns: ([^\n]*)", 1)
        basis = periods.basis_of(F.col("text"))
        other = F.arrays_overlap(F.split(basis, " / "), F.array(*(F.lit(n) for n, _ in periods.BASES))) & ~F.arrays_overlap(F.split(basis, " / "), F.array(*map(F.lit, line.b)))
        denotes = lambda c: reduce(or_, [periods.column_matches(c, F.lit(y), F.lit(p), periods.expected_end(F.lit(y), F.lit(p), month, day)) for y, p in asked])
        lane = own.where(in_any({*asked, *((y + 1, p) for y, p in asked)}) & _is_table(own))
        matching = lane.where(~headings.contains("NOT ALIGNED") & ~other & F.exists(F.split(headings, r" \| "), denotes))
        found = best(search(lane, 3 * cfg.period_candidates).join(matching.select(F.col("chunk_id").alias("doc_id")), "doc_id", "left_semi"), cfg.period_candidates)
        reported = matching.where(basis == "reported").join(found.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_anti")
        reported = reported.orderBy(~in_any(asked), "chunk_index", "chunk_id").limit(cfg.reported_tables)
        return [prose, found.union(reported.select(F.col("chunk_id").alias("doc_id"), F.lit(0.0).alias("score")))]

    def _evidence(self) -> DataFrame:
        t = self.chunks().withColumn("s", self.models.sentiment(F.col("text")))
        section = F.col("section") if "section" in t.columns else F.lit(None).cast("string")
        return t.select(F.col("ticker").alias("entity"), "source_id", "chunk_id", "chunk_index", section.alias("section"), "attribution", "date", "s.*")

    def sentiment(self, as_of: str) -> DataFrame:
        """(entity, status, last_document_date, score, confidence, documents) of every entity at once."""
        evidence, day = self._evidence(), F.lit(as_of).cast("date")
        scores = sentiment.entity_scores(sentiment.document_signals(sentiment.picked(evidence, day), day))
        return sentiment.status(evidence, day).join(scores, "entity", "left")

    def coverage(self) -> DataFrame:
        return sentiment.coverage(self.chunks(), ["ticker", "doc_type"], "date")

    def health(self) -> DataFrame:
        """One row: vectors against chunks, by the hash of the text that each vector was made from."""
        held = self.chunks()
        made = F.col("vector_hash") if "vector_hash" in held.columns else F.lit("")
        c = held.select(F.col("chunk_id").alias("id"), F.col("content_hash").alias("hash"))
        v = held.where("embedding is not null").select(F.col("chunk_id").alias("id"), F.coalesce(made, F.lit("")).alias("hash"))
        return store.health(store.reconcile(v, c))
