"""Citations of answers: resolving and renumbering markers, and a lexical check of what they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import content_words, numbers

#: A marker, and where sentences of an answer end.
MARKER = r"\[Source (\d+)\]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z\-*•])"
WEAK = 0.4


def resolved(answers: DataFrame, answer_id: str, answer: str, sources: str) -> DataFrame:
    """(answer_id, marker, number, source): each cited source once, numbered by first appearance; unresolvable markers are dropped.

    sources is the array of what was offered, marker n meaning its nth element.
    """
    t = answers.select(answer_id, F.col(sources).alias("sources"), F.posexplode(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))).alias("at", "marker"))
    t = t.withColumn("marker", F.expr("try_cast(marker as int)")).where(F.col("marker").between(1, F.size("sources")))
    first = t.groupBy(answer_id, "marker").agg(F.min("at").alias("at"), F.first("sources").alias("sources"))
    number = F.dense_rank().over(Window.partitionBy(answer_id).orderBy("at")).cast("long")
    return first.select(answer_id, F.col("marker").cast("long").alias("marker"), number.alias("number"), F.element_at("sources", F.col("marker")).alias("source"))


def rewritten(answer: str | Column, sources: str | Column) -> Column:
    """The answer with markers renumbered by first appearance, unresolvable ones removed and blanks collapsed."""
    text = F.col(answer) if isinstance(answer, str) else answer
    markers = F.transform(F.regexp_extract_all(text, F.lit(MARKER), F.lit(1)), lambda m: F.when(F.length(m) < 9, m.cast("int")))
    known = F.filter(markers, lambda m: m.between(1, F.size(sources)))
    order = F.array_distinct(known)
    parts = F.arrays_zip(F.split(text, MARKER, -1).alias("piece"), markers.alias("marker"))
    put = lambda x: F.when(F.array_contains(order, x["marker"]), F.concat(F.lit("[Source "), F.array_position(order, x["marker"]), F.lit("]"))).otherwise("")
    joined = F.array_join(F.transform(parts, lambda x: F.concat(x["piece"], F.when(x["marker"].isNull(), "").otherwise(put(x)))), "")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[ \t]{2,}", " "), r"\s+([.,;:!?])", "$1"))


def support(claims: DataFrame, claim_id: list[str], sentence: str, cited: str) -> DataFrame:
    """Adds verdict, missing (numbers) and overlap of each sentence against the texts it cites, an array; empty means uncited.

    Uncited sentences without a number have no verdict and are left out.
    """
    claim = F.regexp_replace(F.col(sentence), MARKER, "")
    source = F.lower(F.array_join(cited, " "))
    t = claims.withColumn("_words", content_words(claim)).withColumn("_source", source).withColumn("_numbers", numbers(claim))
    t = t.withColumn("missing", F.sort_array(F.array_except("_numbers", numbers("_source"))))
    found = F.size(F.filter("_words", lambda w: F.contains(F.col("_source"), w)))
    t = t.withColumn("overlap", F.when(F.size("_words") > 0, F.round(found / F.size("_words"), 2)).otherwise(1.0))
    bare = F.size(cited) == 0
    verdict = (
        F.when(bare & (F.size("_numbers") > 0), "uncited_claim")
        .when(bare, None)
        .when(F.size("missing") > 0, "number_not_in_source")
        .when(F.when(F.size("_words") > 0, found / F.size("_words")).otherwise(1.0) < WEAK, "weak_overlap")
        .otherwise("supported_lexically")
    )
    t = t.withColumn("verdict", verdict).where(F.col("verdict").isNotNull())
    missing = F.when(F.col("verdict") == "uncited_claim", F.sort_array("_numbers")).otherwise(F.col("missing"))
    return t.select(*claim_id, "verdict", missing.alias("missing"), F.when(~bare, F.col("overlap")).alias("overlap"))


def assessed(answers: DataFrame, answer_id: str, answer: str, cited: str) -> DataFrame:
    """(answer_id, place, sentence, sources, verdict, missing, overlap): an answer cut into sentences, each against the texts its markers name.

    cited holds the text of marker n at place n. Markers beyond it count as a citation of nothing.
    """
    parts = F.filter(F.transform(F.split(F.trim(F.col(answer)), SENTENCE_END, -1), F.trim), lambda s: s != "")
    t = answers.select(F.col(answer_id), F.col(cited).alias("_cited"), F.posexplode(parts).alias("place", "sentence"))
    named = F.transform(F.regexp_extract_all("sentence", F.lit(MARKER), F.lit(1)), lambda m: F.when(F.length(m) < 9, m.cast("int")).otherwise(0))
    t = t.withColumn("sources", F.sort_array(F.array_distinct(named)))
    held = F.transform(F.filter("sources", lambda n: n.between(1, F.size("_cited"))), lambda n: F.element_at("_cited", n))
    texts = F.when((F.size("sources") > 0) & (F.size(held) == 0), F.array(F.lit(""))).otherwise(held)
    t = t.withColumn("_texts", texts).withColumn("_key", F.struct(answer_id, "place", "sentence", "sources"))
    return support(t, ["_key"], "sentence", "_texts").select("_key.*", "verdict", "missing", "overlap")
