"""Keyword and vector search, fusion and reranking over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, excerpt, token_count, tokens
from docloom.operators import bm25, fusion, vectors
from docloom.plans.registry import query, table

TOKENS = f"regexp_extract_all(lower(text), '{TOKEN}')"
QUERY = "SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)"

POSTINGS = f"""
  tok AS (SELECT doc_id, {TOKENS} AS toks FROM documents),
  post AS (SELECT doc_id, token, len, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS token FROM tok) GROUP BY ALL),
  stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
  raw AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stats GROUP BY token),
  idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
SCORED = """
  scored AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))) AS score
             FROM post JOIN wanted USING (token) JOIN idf USING (token), stats GROUP BY query_id, doc_id)"""
ONE = f"wanted AS (SELECT 0 AS query_id, token, count(*) AS times FROM (SELECT unnest({TOKENS}) AS token FROM ({QUERY})) GROUP BY token)"
MANY = f"wanted AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY ALL)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _first_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(F.lit(0).alias("query_id"), F.col("text").alias("query"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("tokenize", f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, array_to_string({TOKENS}[1:5], ' ') AS first_tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _docs(spark, sf_dir).select("doc_id", tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


@query("token_counts", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))::BIGINT AS tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", token_count("text").alias("tokens"))


@query("df_idf", f"WITH {POSTINGS} SELECT token, df::BIGINT AS df, round(idf, 6) AS idf FROM idf")
def df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return bm25.idf(docs, "text").select("token", "df", F.round("idf", 6).alias("idf"))


@query("bm25_scores", f"WITH {POSTINGS}, {ONE}, {SCORED} SELECT doc_id, round(score, 4) AS score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(_docs(spark, sf_dir), _first_question(spark, sf_dir)).select("doc_id", F.round("score", 4).alias("score"))


@query("bm25_topk", f"WITH {POSTINGS}, {ONE}, {SCORED} SELECT doc_id, round(coalesce(score, 0), 4) AS score FROM documents LEFT JOIN scored USING (doc_id) ORDER BY round(coalesce(score, 0), 9) DESC, doc_id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one question's fifty best documents."""
    docs = _docs(spark, sf_dir)
    scored = bm25.scores(docs, _first_question(spark, sf_dir)).select("doc_id", "score")
    every = docs.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return every.orderBy(F.round("score", 9).desc(), "doc_id").limit(50).select("doc_id", F.round("score", 4).alias("score"))


@query("bm25_filtered_topk", f"WITH {POSTINGS}, {ONE}, {SCORED} SELECT doc_id, round(coalesce(score, 0), 4) AS score FROM documents LEFT JOIN scored USING (doc_id) WHERE source = 'src1' AND lang = 'en' ORDER BY round(coalesce(score, 0), 9) DESC, doc_id LIMIT 50")
def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics stay those of the whole corpus; the filter applies to what was scored."""
    docs = _docs(spark, sf_dir)
    scored = bm25.scores(docs, _first_question(spark, sf_dir)).select("doc_id", "score")
    some = docs.where("source = 'src1' and lang = 'en'").select("doc_id")
    every = some.join(scored, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return every.orderBy(F.round("score", 9).desc(), "doc_id").limit(50).select("doc_id", F.round("score", 4).alias("score"))


BATCH = f"WITH {POSTINGS}, {MANY}, {SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)"


def _batch(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return bm25.best(_docs(spark, sf_dir), _questions(spark, sf_dir), k)


@query("bm25_batch", f"{BATCH} SELECT query_id, doc_id, rank::BIGINT AS rank, round(score, 4) AS score FROM best WHERE rank <= 10")
def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


UNIT = "unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8::DOUBLE)) AS unit FROM embeddings)"
NEAR = "near AS (SELECT q.vec_id AS query_id, v.vec_id, greatest(0::DOUBLE, least(1::DOUBLE, list_inner_product(v.unit, q.unit))) AS score, v.label FROM unit v, unit q WHERE q.vec_id {asked})"


@query("l2_norm", f"WITH {UNIT} SELECT vec_id, round(unit[1], 6) AS first, round(unit[64], 6) AS last, len(unit)::BIGINT AS dim FROM unit")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "embeddings").select("vec_id", vectors.normalised("embedding").alias("u"))
    return t.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.size("u").cast("long").alias("dim"))


def _nearest(spark: SparkSession, sf_dir: str, which: str, k: int, only: str = "true") -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi") if which == "questions" else e.where(which)
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.search(e.where(only), queries, k)


@query("knn_topk", f"WITH {UNIT}, {NEAR.format(asked="= 7")} SELECT vec_id, round(score, 4) AS score FROM near ORDER BY round(score, 9) DESC, vec_id LIMIT 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "vec_id = 7", 10).select("vec_id", F.round("score", 4).alias("score"))


@query("knn_filtered", f"WITH {UNIT}, {NEAR.format(asked="= 7")} SELECT vec_id, round(score, 4) AS score FROM near WHERE label IN (1, 3) ORDER BY round(score, 9) DESC, vec_id LIMIT 10")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact within the filter, which is applied before any vector is scored."""
    return _nearest(spark, sf_dir, "vec_id = 7", 10, "label in (1, 3)").select("vec_id", F.round("score", 4).alias("score"))


@query("knn_batch", f"WITH {UNIT}, {NEAR.format(asked="% 100 = 0")} SELECT query_id, vec_id, rank::BIGINT AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near) WHERE rank <= 10")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, "vec_id % 100 = 0", 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query(
    "trust_filter",
    """WITH h AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN '' ELSE md5(vec_id::VARCHAR) END AS vec_hash FROM embeddings),
         c AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN md5('changed') ELSE md5(vec_id::VARCHAR) END AS text_hash FROM embeddings WHERE vec_id % 3 <> 0)
       SELECT h.vec_id, vec_hash FROM h LEFT JOIN c USING (vec_id) WHERE vec_hash <> '' AND (text_hash IS NULL OR text_hash = '' OR text_hash = vec_hash)""",
)
def trust_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.md5(F.col("vec_id").cast("string").cast("binary"))
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    hits = e.withColumn("vec_hash", F.when(F.col("vec_id") % 7 == 0, "").otherwise(own))
    current = e.where("vec_id % 3 <> 0").withColumn("text_hash", F.when(F.col("vec_id") % 5 == 0, F.md5(F.lit("changed").cast("binary"))).otherwise(own))
    return vectors.trusted(hits, current)


@query("index_validate", "SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
def index_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.index_facts(table(spark, sf_dir, "embeddings"))


MINMAX = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query("minmax", f"{BATCH}, b AS (SELECT * FROM best WHERE rank <= 10) SELECT query_id, doc_id, round({MINMAX}, 6) AS scaled FROM b WINDOW w AS (PARTITION BY query_id)")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("query_id", "doc_id", F.round(fusion.min_max("score", "query_id"), 6).alias("scaled"))


# The dense side of the fusion queries: question q looks with vector q for documents of the vectors' ids.
DENSE = "dn AS (SELECT query_id, vec_id AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near) WHERE rank <= 10)"
MERGED = f"""{BATCH}, {UNIT}, {NEAR.format(asked="IN (SELECT item_id FROM benchmark)")}, {DENSE},
  d AS (SELECT query_id, doc_id, {MINMAX} AS dense FROM dn WINDOW w AS (PARTITION BY query_id)),
  s AS (SELECT query_id, doc_id, {MINMAX} AS sparse FROM best WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)),
  m AS (SELECT query_id, doc_id, dense IS NOT NULL AS has_dense, sparse IS NOT NULL AS has_sparse, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse FROM d FULL OUTER JOIN s USING (query_id, doc_id))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dense = _nearest(spark, sf_dir, "questions", 10).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return dense, _batch(spark, sf_dir).select("query_id", "doc_id", "score")


@query("hybrid_merge", f"{MERGED} SELECT query_id, doc_id, round(dense, 6) AS dense, round(sparse, 6) AS sparse, round(0.6::DOUBLE * dense + 0.4::DOUBLE * sparse, 6) AS hybrid FROM m")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fusion.merge(*_sides(spark, sf_dir))
    return m.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("dense", "sparse", "hybrid")))


@query("overlap_diag", f"{MERGED} SELECT query_id, count(*) FILTER (WHERE has_dense) AS dense_hits, count(*) FILTER (WHERE has_sparse) AS sparse_hits, count(*) FILTER (WHERE has_dense AND has_sparse) AS overlap, CASE WHEN count(*) FILTER (WHERE has_dense) > 0 THEN 'hybrid' ELSE 'sparse_only' END AS mode FROM m GROUP BY query_id")
def overlap_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, sparse = _sides(spark, sf_dir)
    both = dense.select("query_id", "doc_id", F.lit(True).alias("has_dense")).join(sparse.select("query_id", "doc_id", F.lit(True).alias("has_sparse")), ["query_id", "doc_id"], "full_outer")
    return fusion.diagnostics(both.na.fill(False, ["has_dense", "has_sparse"]))


POOL = """SELECT stage, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY stage, score DESC, doc_id) AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, score DESC, doc_id) AS n FROM (
      SELECT 0 AS stage, doc_id, (n_chars % 1000)::DOUBLE AS score, sha256(text) AS content_hash FROM documents WHERE lang = 'es'
      UNION ALL SELECT 1, doc_id, (n_chars % 777)::DOUBLE, sha256(text) FROM documents WHERE lang = 'fr'
      UNION ALL SELECT 2, doc_id, (n_chars % 555)::DOUBLE, sha256(text) FROM documents)) WHERE n = 1) WHERE m = 1"""


@query("dedupe_pool", POOL)
def dedupe_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    part = lambda df, n: df.select("doc_id", (F.col("n_chars") % n).cast("double").alias("score"))
    known = docs.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))
    # All of every list: the last one's limit is as many as there are documents.
    return fusion.pool([part(docs.where("lang = 'es'"), 1000), part(docs.where("lang = 'fr'"), 777), part(docs, 555)], known, docs.count())


@query("ordered_union", "SELECT stage, doc_id FROM (SELECT 0 AS stage, doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT 1, doc_id FROM documents WHERE lang = 'es' UNION ALL SELECT 2, doc_id FROM documents WHERE source = 'src2')")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    lists = [docs.where(w).select(F.lit(k).alias("stage"), "doc_id") for k, w in enumerate(("lang = 'de'", "lang = 'es'", "source = 'src2'"))]
    return lists[0].union(lists[1]).union(lists[2]).orderBy("stage", "doc_id")


@query("scope_except", "SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM documents WHERE source IN ('src0', 'src1')")
def scope_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.where("lang = 'en'").select("doc_id").join(docs.where("source in ('src0', 'src1')").select("doc_id"), "doc_id", "left_anti").distinct()


@query("scope_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def scope_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))



@query(
    "maxp",
    f"""WITH q AS (SELECT list_distinct({TOKENS}) AS q FROM ({QUERY})), w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
        SELECT doc_id, round(max(len(list_intersect(list_distinct({TOKENS}), q))::DOUBLE / len(q)), 6) AS score FROM w, q GROUP BY doc_id""",
)
def maxp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document scores as its best window (here: line) does; windows fan out, are scored, and fan in by max."""
    q = _first_question(spark, sf_dir).select(F.array_distinct(tokens("query")).alias("q"))
    windows = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("window")).crossJoin(F.broadcast(q))
    score = F.size(F.array_intersect(F.array_distinct(tokens("window")), "q")) / F.size("q")
    return windows.groupBy("doc_id").agg(F.round(F.max(score), 6).alias("score"))


@query(
    "evidence_budget",
    f"""{BATCH}, r AS (SELECT query_id, doc_id, doc_id % 3 = 0 AS is_table, score FROM best WHERE rank <= 10),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_table ORDER BY round(score, 9) DESC, doc_id) AS place FROM r),
        t AS (SELECT *, count(*) FILTER (WHERE is_table AND place <= 2) OVER (PARTITION BY query_id) AS tables FROM p)
        SELECT query_id, doc_id, is_table, round(score, 4) AS score FROM t WHERE place <= CASE WHEN is_table THEN 2 ELSE 5 - tables END""",
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _batch(spark, sf_dir).withColumn("is_table", F.col("doc_id") % 3 == 0)
    return fusion.evidence(ranked, 5, 2, order="rank").withColumn("score", F.round("score", 4))


@query("excerpt", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents")
def excerpt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", excerpt("text").alias("excerpt"))
