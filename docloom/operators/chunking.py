"""Greedy chunking of sentences and paging of table rows; folds that no window expresses, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import sentences
from docloom.sources.filings import sections as filing_sections

_token = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def count_tokens(text: str) -> int:
    return len(_token.findall(text))


@dataclass(frozen=True)
class Limits:
    """Tokens: boundary is min(target, most); a tail below least joins its predecessor."""

    target: int = 500
    most: int = 600
    least: int = 50
    overlap: int = 50

    @property
    def boundary(self) -> int:
        return min(self.target, self.most) if self.target > 0 else self.most


def _hard_cut(sentence: str, most: int) -> list[str]:
    """A sentence over the limit in pieces of so many tokens, without overlap."""
    starts = [m.start() for m in _token.finditer(sentence)][::most]
    return [sentence[a:b].strip() for a, b in zip(starts, [*starts[1:], len(sentence)], strict=True)]


def pack(parts: list[str], limits: Limits, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Chunks of whole sentences; each begins with the last sentences of the one before that fit the overlap."""
    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    for sentence in parts:
        n = count(sentence)
        if n > limits.most:
            if held:
                chunks.append(" ".join(s for s, _ in held))
            held = []
            chunks += _hard_cut(sentence, limits.most)
            continue
        if held and sum(k for _, k in held) + n > limits.boundary:
            chunks.append(" ".join(s for s, _ in held))
            room, carried = limits.overlap, []
            for s, k in reversed(held):
                if k > room:
                    break
                room -= k
                carried.append((s, k))
            held = carried[::-1]
        held.append((sentence, n))
    if held:
        tail = " ".join(s for s, _ in held)
        if count(tail) >= limits.least or not chunks:
            chunks.append(tail)
        else:
            chunks[-1] += " " + tail
    return chunks


def chunked(docs: DataFrame, doc_id: str, text: str, target: int, most: int, least: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, chunk)."""
    limits = Limits(target, most, least, overlap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pack(s or [], limits) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.list_(pa.string()))], names=["id", "chunks"])

    rows = docs.select(F.col(doc_id).alias("id"), sentences(text).alias("sentences"))
    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, chunks array<string>")
    return made.select(F.col("id").alias(doc_id), F.posexplode("chunks").alias("chunk_index", "chunk"), F.size("chunks").cast("long").alias("total_chunks")).select(
        doc_id, F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", "chunk"
    )


def filing_chunks(filings: DataFrame, doc_id: str, form: str, text: str, limits: Limits) -> DataFrame:
    """(doc_id, section, chunk_index, chunk): a filing's sections in order, each chunked by itself, under one running index.

    Blank sections give none; filings of other forms are one section, full_text.
    """
    cut = filings.select(doc_id, F.posexplode(filing_sections(F.coalesce(F.col(text), F.lit("")), F.col(form))).alias("place", "s"))
    parts = cut.select(F.struct(doc_id, "place", F.col("s.name").alias("section")).alias("part"), F.col("s.text").alias("text"))
    made = chunked(parts.where(F.trim("text") != ""), "part", "text", limits.target, limits.most, limits.least, limits.overlap)
    running = F.row_number().over(Window.partitionBy(f"part.{doc_id}").orderBy("part.place", "chunk_index")) - 1
    return made.select(F.col(f"part.{doc_id}").alias(doc_id), "part.section", running.cast("long").alias("chunk_index"), "chunk")


def pages(lines: list[str], most: int, extra: int = 0) -> list[list[str]]:
    """Lines in pages of at most so many tokens (each line counting extra more), a longer line alone."""
    out: list[list[str]] = [[]]
    used = 0
    for text in lines:
        n = count_tokens(text) + extra
        if out[-1] and used + n > most:
            out.append([])
            used = 0
        out[-1].append(text)
        used += n
    return out


def paged_rows(rows: DataFrame, by: str, order: str, line: Column, most: int) -> DataFrame:
    """(by, part, parts, body): a table's rendered rows in pages of at most so many tokens, as part k of n."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [["\n".join(p) for p in pages(x, most)] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.string()))], names=["owner", "pages"])

    t = rows.groupBy(F.col(by).alias("owner")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))).alias("held"))
    made = t.select("owner", F.col("held.line").alias("lines")).mapInArrow(run, f"owner {t.schema['owner'].dataType.simpleString()}, pages array<string>")
    paged = made.select(F.col("owner").alias(by), F.posexplode("pages").alias("at", "body"), F.size("pages").cast("long").alias("parts"))
    return paged.select(by, (F.col("at") + 1).cast("long").alias("part"), "parts", "body")
