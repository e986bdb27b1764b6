"""Answers from evidence: the prompt, an offline extractive answer or abstention, its citations and what they support.

Evidence is (query_id, question, rank, ticker, header, source, text), a few rows for each question, for all questions
at once. A model is a function from (question, prompt, texts) to an answer; the default quotes the evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import sentences, tokens
from docloom.operators import citations

#: What is said without evidence, and the tag that encloses a source's text.
ABSTENTION = "I don't have enough information to answer this question."
TAG = "document"
QUOTES = 3

Answerer = Callable[[Column, Column, Column], Column]


def block(number: Column, ticker: Column, header: Column, source: Column, text: Column) -> Column:
    """One numbered source of a prompt; a closing tag inside its text is broken, so it can't end the source."""
    safe = F.regexp_replace(text, rf"(?i)<\s*/\s*{TAG}\s*>", f"</ {TAG}>")
    lines = (F.concat(F.lit("[Source "), number.cast("string"), F.lit("]")), F.concat(F.lit("Ticker: "), ticker), F.concat(F.lit("Document: "), header), F.concat(F.lit("Source: "), source), F.lit(f"<{TAG}>"), safe, F.lit(f"</{TAG}>\n"))
    return F.concat_ws("\n", *lines)


def prompts(evidence: DataFrame) -> DataFrame:
    """(query_id, question, texts, prompt): a question's sources in order of rank, numbered from 1, then the question."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = evidence.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", *(empty(c).alias(c) for c in ("ticker", "header", "source", "text"))))).alias("rows"))
    blocks = F.transform("rows", lambda r, i: block(i + 1, r["ticker"], r["header"], r["source"], r["text"]))
    prompt = F.concat(F.lit("Context:\n\n"), F.array_join(blocks, "\n"), F.lit("\nQuestion: "), F.col("question"), F.lit("\n\nAnswer:"))
    return rows.select("query_id", "question", F.transform("rows", lambda r: r["text"]).alias("texts"), prompt.alias("prompt"))


def extractive(question: Column, prompt: Column, texts: Column) -> Column:
    """Of each source the sentence that shares most of the question's words, the best QUOTES of them, each with its marker."""
    asked = F.array_distinct(tokens(question))
    share = lambda s: F.size(F.array_intersect(asked, tokens(s)))
    scored = lambda t, i: F.array_max(F.transform(sentences(t), lambda s, k: F.struct(share(s).alias("n"), (-i).alias("source"), (-k).alias("place"), s.alias("text"))))
    best = F.filter(F.transform(texts, scored), lambda x: x.isNotNull() & (x["n"] > 0))
    quotes = F.slice(F.reverse(F.array_sort(best)), 1, QUOTES)
    quoted = F.array_join(F.transform(quotes, lambda q: F.concat(q["text"], F.lit(" [Source "), (1 - q["source"]).cast("string"), F.lit("]"))), " ")
    return F.when(F.size(quotes) > 0, quoted).otherwise(ABSTENTION)


def answered(questions: DataFrame, evidence: DataFrame, model: Answerer = extractive) -> DataFrame:
    """(query_id, question, answer, texts, cited) for every question (query_id, question); without evidence, the abstention.

    Markers are renumbered by first appearance and cited are the texts they then stand for; those that name no source are dropped.
    """
    t = questions.select("query_id", "question").join(prompts(evidence).drop("question"), "query_id", "left")
    none = F.array().cast("array<string>")
    t = t.withColumn("texts", F.coalesce("texts", none))
    raw = F.when(F.size("texts") > 0, model(F.col("question"), F.col("prompt"), F.col("texts"))).otherwise(ABSTENTION)
    t = t.withColumn("raw", raw)
    numbers = F.transform(F.regexp_extract_all("raw", F.lit(citations.MARKER), F.lit(1)), lambda m: F.when(F.length(m) < 9, m.cast("int")))
    order = F.array_distinct(F.filter(numbers, lambda m: m.between(1, F.size("texts"))))
    cited = F.transform(order, lambda n: F.element_at("texts", n))
    return t.select("query_id", "question", citations.rewritten("raw", "texts").alias("answer"), "texts", cited.alias("cited"))


def supported(answers: DataFrame) -> DataFrame:
    """(query_id, place, sentence, sources, verdict, missing, overlap) of every sentence of answers (query_id, answer, cited) that is judged."""
    return citations.assessed(answers, "query_id", "answer", "cited")
