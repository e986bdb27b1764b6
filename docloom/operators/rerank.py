"""Reranking: windows of candidates, scored apart, a candidate scoring as its best window does."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 150
#: Fixed value: texts of which windows are held at once.
TEXTS = 200
#: Fixed value: where a sentence ends for windows.
WINDOW_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"
_cut = re.compile(WINDOW_SENTENCE).split


def half_overlapping(parts: list[str], words: int = WORDS) -> list[str]:
    """Windows of consecutive sentences of at most so many words (a longer sentence alone); the next begins half-way through the one before."""
    before = [0, *accumulate(len(p.split()) for p in parts)]
    out: list[str] = []
    a = z = 0
    while z < len(parts):
        # As far as the words allow, but one sentence at least.
        z = max(a + 1, bisect_right(before, before[a] + words) - 1)
        out.append(" ".join(parts[a:z]))
        a += max(1, (z - a) // 2)
    return out


def windows_of(text: str | None, words: int = WORDS) -> list[str]:
    """A text that fits one window is that window, as it is."""
    text = text or ""
    if words <= 0 or len(text.split()) <= words:
        return [text]
    return half_overlapping([s for s in _cut(text) if s.strip()], words)


def in_parts(batches: Iterator[pa.Array], words: int = WORDS) -> Iterator[pa.Array]:
    """The windows of each text, handed on TEXTS at a time, so that a worker never holds a whole batch's."""
    for b in batches:
        for a in range(0, len(b), TEXTS):
            yield pa.array([windows_of(s, words) for s in b.slice(a, TEXTS).to_pylist()], pa.list_(pa.string()))


def windows(text: str | Column, words: int = WORDS) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return in_parts(batches, words)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<string>")(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def row_windows(rendered: Column, columns: Column) -> Column:
    """Each row of a rendered table as one statement under title and units, cut to the wanted columns by name (empty or null: all).

    Rows without a wanted column give none; a table without any such row is one window, whole.
    """
    lines = F.split(rendered, "\n")
    first = lambda mark: F.coalesce(F.get(F.filter(lines, lambda x: x.startswith(mark)), F.lit(0)), F.lit(""))
    body = F.filter(lines, lambda x: x.contains(" = ") & ~x.startswith("Table:") & ~x.startswith("Columns:"))
    label = lambda x: F.substring_index(x, ": ", 1)
    cells = lambda x: F.split(F.substring(x, F.length(label(x)) + 3, F.length(x)), "; ")
    named = lambda c: F.array_contains(columns, F.substring_index(c, " = ", 1))
    every = F.coalesce(F.size(columns), F.lit(0)) <= 0
    wanted = lambda x: F.filter(cells(x), lambda c: every | named(c))
    made = F.transform(F.filter(body, lambda x: F.size(wanted(x)) > 0), lambda x: F.concat(first("Table: "), F.lit(" ("), first("Units: "), F.lit("): "), label(x), F.lit(": "), F.array_join(wanted(x), "; ")))
    return F.when(F.size(made) > 0, made).otherwise(F.array(rendered))


def rerank(candidates: DataFrame, relevance: Callable[[Column, Column], Column], top_k: int | None = None, words: int = WORDS) -> DataFrame:
    """Candidates (query_id, doc_id, question, text) by final_score, the best of their windows' relevance.

    Further columns that count where they are there: is_table (scored whole), lane (of "table": row by row, by
    match_columns) and header (put before each window).
    """
    has = lambda c, other: F.coalesce(F.col(c), other) if c in candidates.columns else other
    in_lane = has("lane", F.lit("")) == "table"
    wanted = F.col("match_columns") if "match_columns" in candidates.columns else F.array().cast("array<string>")
    plain = F.when(in_lane, row_windows(F.col("text"), wanted)).when(has("is_table", F.lit(False)), F.array("text")).otherwise(F.col("windows"))
    head = F.when(has("header", F.lit("")) != "", F.concat(has("header", F.lit("")), F.lit("\n"))).otherwise("")
    fanned = candidates.withColumn("windows", windows("text", words)).withColumn("windows", F.transform(plain, lambda w: F.concat(head, w)))
    fanned = fanned.select("query_id", "doc_id", "question", F.explode_outer("windows").alias("window"))
    scored = fanned.groupBy("query_id", "doc_id").agg(F.coalesce(F.max(relevance(F.col("question"), F.coalesce("window", F.lit("")))), F.lit(0.0)).alias("final_score"))
    ranked = candidates.join(scored, ["query_id", "doc_id"]).orderBy(F.col("final_score").desc(), "doc_id")
    return ranked.limit(top_k) if top_k else ranked
