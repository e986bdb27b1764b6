"""Exact BM25 (Okapi) over a corpus: statistics of the whole corpus, scores for one query or many.

One pass counts, by token with partial sums before the shuffle, in how many documents each token is, and all
lengths; another counts in each row the tokens that are asked for, without a shuffle of postings. Asked tokens go
to the tasks as a list of MOST_WANTED at most; more of them are joined instead. The best of many queries at once are
found within tasks (best), so that no (query, document) pair is shuffled but each task's best.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, tokens
from docloom.operators.best import Best, ranked, schema_of

#: The usual parameters; epsilon scales the mean idf that replaces negative ones.
K1, B, EPSILON = 1.5, 0.75, 0.25


MOST_WANTED = 10_000
#: Pairs of query and token up to which best() works in tasks; texts at a time; distinct tokens a task counts before it hands them on; scores at a time.
MOST_PAIRS, TEXTS, HELD, CELLS = 200_000, 256, 200_000, 65_536
_find = re.compile(TOKEN).findall


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, TEXTS):
            yield b.slice(a, TEXTS)


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(token, df, len): documents with each token; the null token stands for all documents, len being their tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: Counter, n: int = 0, total: int = 0) -> pa.RecordBatch:
            columns = [[None, *held], [n, *held.values()], [total, *[None] * len(held)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["token", "df", "len"])

        held, n, total = Counter(), 0, 0
        for b in _texts(batches):
            for x in b.column(0).to_pylist():
                found = _find(x or "")
                n += 1
                total += len(found)
                held.update(set(found))
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
        yield rows(held, n, total)

    t = docs.select(F.lower(text).alias("text")).mapInArrow(run, "token string, df long, len long")
    return t.groupBy("token").agg(F.sum("df").alias("df"), F.sum("len").alias("len"))


def _raw(n: int) -> Column:
    return F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)


def _floored(raw: str, mean: float | None) -> Column:
    """Negative values give way to epsilon times the mean of all values before."""
    return F.when(F.col(raw) < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(F.col(raw))


def idf(docs: DataFrame, text: str) -> DataFrame:
    """(token, df, idf) of the whole vocabulary."""
    found = vocabulary(docs, text).where("token is not null").withColumn("raw", _raw(docs.count()))
    return found.select("token", "df", _floored("raw", found.agg(F.avg("raw")).first()[0]).alias("idf"))


def _tf(docs: DataFrame, doc_id: str, text: str, words: list[str] | None) -> DataFrame:
    """(doc_id, len, token, tf), of the given words in each row or, for none given, of all by a group-by."""
    t = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("tokens")).withColumn("len", F.size("tokens"))
    if words is None:
        return t.select("doc_id", "len", F.explode("tokens").alias("token")).groupBy("doc_id", "len", "token").agg(F.count("*").alias("tf"))
    asked = F.array_intersect("tokens", F.array(*map(F.lit, words)).cast("array<string>"))
    counted = F.transform(asked, lambda w: F.struct(w.alias("token"), F.size(F.filter("tokens", lambda x: x == w)).alias("tf")))
    return t.select("doc_id", "len", F.explode(counted).alias("hit")).select("doc_id", "len", "hit.*")


def _wanted(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(tokens("query")).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))


def scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score) for documents that share a token with the query; queries has query_id and query.

    A token repeated in a query counts each time. Documents that aren't here score 0.
    """
    wanted = _wanted(queries)
    words = [r[0] for r in wanted.select("token").distinct().limit(MOST_WANTED + 1).collect()]
    few = len(words) <= MOST_WANTED
    n = docs.count()
    every = vocabulary(docs, text).withColumn("raw", _raw(n))
    total = _total(every, words if few else None)
    if few:
        made = docs.sparkSession.createDataFrame([(r.token, float(r.raw)) for r in total.asked], "token string, raw double")
    else:
        made = every.where("token is not null").select("token", "raw")
    weights = wanted.join(made, "token").select("query_id", "token", "times", _floored("raw", total.mean).alias("idf"))
    hits = _tf(docs, doc_id, text, words if few else None).join(weights, "token")
    average = (total.len or 0) / n if n else 0.0
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def _total(every: DataFrame, words: list[str] | None) -> Row:
    """mean of raw values, len of all documents, and asked, the raw values of words if there are any."""
    asked = F.lit(None) if words is None else F.collect_list(F.when(F.col("token").isin(words), F.struct("token", "raw")))
    return every.agg(F.avg(F.when(F.col("token").isNotNull(), F.col("raw"))).alias("mean"), F.max("len").alias("len"), asked.alias("asked")).first()


def best(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query among those that share a token with it, by score to nine digits, ties by doc_id.

    Each task adds up its documents' scores and keeps k of each query. With very many questions, or ids that several
    rows share (whose scores add up), it is scores() that is ranked.
    """
    asked = _wanted(queries).limit(MOST_PAIRS + 1).collect()
    words = sorted({r.token for r in asked})
    shared = not docs.groupBy(doc_id).count().where("count > 1").isEmpty()
    if shared or len(asked) > MOST_PAIRS or len(words) > MOST_WANTED:
        return ranked(scores(docs, queries, doc_id, text).withColumn("rounded", F.round("score", 9)), k, "doc_id")
    n = docs.count()
    total = _total(vocabulary(docs, text).withColumn("raw", _raw(n)), words)
    average = ((total.len or 0) / n if n else 0.0) or 1.0
    idf = {r.token: EPSILON * (total.mean or 0.0) if r.raw < 0 else r.raw for r in total.asked}
    # Words' queries one after the other, with where each word's begin: what a hit of a word adds to.
    names = sorted({r.query_id for r in asked})
    number = {q: j for j, q in enumerate(names)}
    pairs = sorted((r.token, number[r.query_id], r.times * idf[r.token]) for r in asked if r.token in idf)
    at = {w: j for j, w in enumerate(sorted(idf))}
    of_word = np.array([at[w] for w, *_ in pairs], int)
    of_query, weight = np.array([q for _, q, _ in pairs], int), np.array([x for *_, x in pairs], float)
    first = np.searchsorted(of_word, np.arange(len(at) + 1))
    schema = schema_of(queries.schema["query_id"], docs.schema[doc_id], "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, step = Best(len(names), k), max(1, CELLS // max(1, len(names)))
        for b in _texts(batches):
            ids = np.array(b.column(0).to_pylist())
            found = [_find(x or "") for x in b.column(1).to_pylist()]
            lengths = np.array([len(x) for x in found], float)
            for a in range(0, len(found), step):
                held = [[at[t] for t in x if t in at] for x in found[a : a + step]]
                doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
                hits, tf = np.unique(doc * len(at) + np.array([j for x in held for j in x], int), return_counts=True)
                if not len(hits):
                    continue
                doc, word = np.divmod(hits, len(at))
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[a + doc] / average))
                many = first[word + 1] - first[word]
                pair = np.repeat(first[word] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                cell = np.repeat(doc, many) * len(names) + of_query[pair]
                # One after the other in order of words, so equal texts have equal scores.
                score = np.bincount(cell, np.repeat(part, many) * weight[pair], len(held) * len(names))
                met = np.flatnonzero(np.bincount(cell, minlength=len(score)))
                doc, query = np.divmod(met, len(names))
                kept.add(query, ids[a + doc], score[met])
        yield from kept.batches(names, schema)

    return ranked(docs.select(doc_id, F.lower(text).alias("text")).mapInArrow(run, schema), k, "doc_id")


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best of each query, ties by doc_id."""
    best = Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, text: str, query: str, k: int, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, score) of one query's k best in the whole corpus; documents without a hit score 0 and take part."""
    queries = docs.sparkSession.createDataFrame([(0, query)], "query_id int, query string")
    found = scores(docs, queries, doc_id, body).drop("query_id")
    every = docs.select(F.col(doc_id).alias("doc_id")).join(found, "doc_id", "left")
    return every.select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)
