"""Keeping a store, measuring latencies, and streams, over embeddings, documents, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import evaluation, sentiment, store, sums, upkeep, vectors
from docloom.plans.registry import query, table
from docloom.streaming import events as streams

HASH = "CASE WHEN vec_id % 7 = 0 THEN '' WHEN vec_id % 5 = 0 THEN md5('old' || vec_id) ELSE md5(vec_id::VARCHAR) END"


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An index of most vectors with some old and blank hashes, and the chunks as they are."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    own = F.md5(F.col("vec_id").cast("string").cast("binary"))
    old = F.md5(F.concat(F.lit("old"), F.col("vec_id").cast("string")).cast("binary"))
    held = e.where("vec_id % 11 <> 0").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 7 == 0, "").when(F.col("vec_id") % 5 == 0, old).otherwise(own).alias("hash"))
    return held, e.where("vec_id % 13 <> 0").select(F.col("vec_id").alias("id"), own.alias("hash"))


SIDES = f"s AS (SELECT vec_id AS id, {HASH} AS hash FROM embeddings WHERE vec_id % 11 <> 0), c AS (SELECT vec_id AS id, md5(vec_id::VARCHAR) AS hash FROM embeddings WHERE vec_id % 13 <> 0)"


@query("upsert_actions", f"WITH {SIDES} SELECT c.id, CASE WHEN s.id IS NULL THEN 'insert' WHEN s.hash = '' OR s.hash <> c.hash THEN 'replace' ELSE 'skip' END AS action FROM c LEFT JOIN s USING (id)")
def upsert_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.upsert_actions(*_index(spark, sf_dir))


@query("upsert_rows", f"WITH {SIDES} SELECT id, hash FROM c UNION ALL SELECT id, hash FROM s WHERE id NOT IN (SELECT id FROM c)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_index(spark, sf_dir), key="id")


@query("delete_rows", f"WITH {SIDES} SELECT id, hash FROM s WHERE id NOT IN (SELECT id FROM c WHERE id % 2 = 0)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _index(spark, sf_dir)
    return store.delete(s, c.where("id % 2 = 0"), "id")


RECONCILED = f"""WITH {SIDES}, b AS (SELECT s.id IS NOT NULL AS v, c.id IS NOT NULL AS h, s.hash AS vh, c.hash AS ch FROM s FULL OUTER JOIN c USING (id)),
  r AS (SELECT count(*) FILTER (WHERE v) AS vectors, count(*) FILTER (WHERE h) AS chunks, count(*) FILTER (WHERE v AND NOT h) AS orphan_vectors, count(*) FILTER (WHERE h AND NOT v) AS without_vector,
    count(*) FILTER (WHERE v AND h AND vh <> '' AND vh <> ch) AS mismatched, count(*) FILTER (WHERE v AND vh = '') AS unknown_hash, count(*) FILTER (WHERE v AND h AND vh <> '' AND vh = ch) AS verified FROM b)"""


@query("reconcile", f"{RECONCILED} SELECT * FROM r")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.reconcile(*_index(spark, sf_dir))


@query("health", f"{RECONCILED} SELECT *, CASE WHEN verified = 0 THEN 'unavailable' WHEN verified < chunks THEN 'partial' ELSE 'full' END AS dense_mode, CASE WHEN verified >= chunks AND verified > 0 THEN 'healthy' ELSE 'degraded' END AS status FROM r")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.health(store.reconcile(*_index(spark, sf_dir)))


@query("cache_split", f"WITH {SIDES} SELECT c.id, coalesce(s.hash <> '' AND s.hash = c.hash, false) AS hit FROM c LEFT JOIN s USING (id)")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = _index(spark, sf_dir)
    return store.cache_split(c, s)


@query(
    "orphans",
    "SELECT 'o' || l_orderkey || '_ch2_' || lpad(l_linenumber::VARCHAR, 4, '0') AS chunk_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) AND l_linenumber > 2",
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for chunks of orders; every third order comes again with two lines. Even lines carry no source."""
    source = F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))
    made = F.concat_ws("_", source, F.lit("ch2"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"))
    held = table(spark, sf_dir, "lineitem").select(made.alias("chunk_id"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(source).alias("source_id"), "l_linenumber")
    sources = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source_id"))
    return store.orphans(held.select("chunk_id", "source_id"), held.where("l_linenumber <= 2"), sources)


@query("schema_backfill", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'known' ELSE sha256(text) END AS content_hash, '' AS source_id, '' AS attribution FROM documents")
def schema_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "known").otherwise("").alias("content_hash"))
    return store.upgraded(old).select("doc_id", "content_hash", "source_id", "attribution")


@query(
    "attribution_first_chunk",
    "SELECT conv_id, turn, CASE WHEN first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) LIKE '%the%' THEN 'news_title' ELSE 'news_body' END AS attribution FROM conversations",
)
def attribution_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole article takes the attribution of its first chunk."""
    of_first = lambda text: F.when(text.contains("the"), "news_title").otherwise("news_body")
    return upkeep.backfill_attribution(table(spark, sf_dir, "conversations"), of_first, "conv_id", "turn").select("conv_id", "turn", "attribution")


@query("period_backfill", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN l_shipdate::DATE END, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate::DATE END) AS period_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def period_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("found"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.col("l_shipdate").cast("date")).alias("period_end"))
    return upkeep.backfill_periods(lines, headers, "l_orderkey").select("l_orderkey", "l_linenumber", "period_end")


@query(
    "missing_periods",
    """SELECT l_returnflag, count(*) AS filings, sum(n)::BIGINT AS chunks FROM (SELECT l_returnflag, l_orderkey, count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS known, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE known = 0 GROUP BY 1""",
)
def missing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("period_end", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate")))
    return upkeep.missing_periods(lines, "l_returnflag", "l_orderkey")


@query("ingest_stats", "SELECT lang, count(*) AS chunks, count(DISTINCT source) AS sources, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.ingest_stats(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")


@query(
    "source_backfill",
    """WITH s AS (SELECT 'src' || (o_orderkey % 500) AS source_id, 'n' || (o_orderkey % 500) AS accession_number FROM orders GROUP BY ALL),
       c AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'news' ELSE '10-K' END AS doc_type, 'src' || (user_id % 700) AS named, CASE WHEN event_id % 5 = 0 THEN 'kept' ELSE '' END AS source_id FROM events)
       SELECT event_id, coalesce(nullif(c.source_id, ''), s.source_id, '') AS source_id, s.accession_number, CASE WHEN s.source_id IS NOT NULL THEN 'filer' ELSE '' END AS attribution FROM c LEFT JOIN s ON c.doc_type <> 'news' AND c.named = s.source_id""",
)
def source_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for chunks whose ids name a source; orders for the filings that are known."""
    e = table(spark, sf_dir, "events")
    chunk = F.concat(F.lit("src"), (F.col("user_id") % 700).cast("string"), F.lit("_ch2_"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    held = e.select("event_id", chunk.alias("chunk_id"), F.when(F.col("event_type") == "error", "news").otherwise("10-K").alias("doc_type"), F.when(F.col("event_id") % 5 == 0, "kept").otherwise("").alias("source_id"), F.lit(None).cast("string").alias("accession_number"), F.lit("").alias("attribution"))
    k = (F.col("o_orderkey") % 500).cast("string")
    sources = table(spark, sf_dir, "orders").select(F.concat(F.lit("src"), k).alias("source_id"), F.concat(F.lit("n"), k).alias("accession_number")).distinct()
    return upkeep.backfill_sources(held, sources).select("event_id", "source_id", "accession_number", "attribution")


@query(
    "rebuild_report",
    """WITH v AS (SELECT vec_id, vec_id % 11 = 0 AS gone, vec_id % 7 = 0 AS other, vec_id % 13 = 0 AS blank FROM embeddings), k AS (SELECT * FROM v WHERE NOT gone)
       SELECT (SELECT count(*) FROM k) AS vectors, (SELECT count(*) FROM v) AS chunks, 0 AS orphan_vectors, (SELECT count(*) FROM v WHERE gone) AS without_vector, (SELECT count(*) FROM k WHERE other AND NOT blank) AS mismatched,
              (SELECT count(*) FROM k WHERE blank) AS unknown_hash, (SELECT count(*) FROM k WHERE NOT other AND NOT blank) AS verified, (SELECT count(*) FROM k) AS compared, (SELECT count(*) FROM k WHERE vec_id % 17 = 0) AS drifted, -1.0::DOUBLE AS worst, false AS verified_all""",
)
def rebuild_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuilt index that lacks some vectors, has others under another or no hash, and turned every 17th around."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    name = F.col("id").cast("string")
    turned = F.when(F.col("id") % 17 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    rebuilt = e.where("id % 11 <> 0").select("id", F.when(F.col("id") % 13 == 0, "").when(F.col("id") % 7 == 0, "other").otherwise(name).alias("hash"), turned.alias("embedding"))
    return upkeep.rebuild_report(e, rebuilt, e.select("id", name.alias("hash"))).withColumn("worst", F.round("worst", 6))


@query(
    "predicted_labels",
    "SELECT user_id AS entity, CASE WHEN avg(value) IS NULL THEN 'unavailable' WHEN avg(value) - 50 > 0.1 THEN 'positive' WHEN avg(value) - 50 < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM events GROUP BY 1",
)
def predicted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean at an edge of neutral is that of values added in order of events, whatever task reads them."""
    score = F.try_divide(F.col("total"), F.col("n")) - 50
    means = sums.totals(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id", F.abs(F.abs(score) - 0.1) < 1e-6)
    return sentiment.predicted_label(means.select(F.col("user_id").alias("entity"), score.alias("score")))


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("event_type").agg(*evaluation.percentiles("value"))
    return t.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")))


@query("last_n_window", "SELECT event_type, round(avg(value), 6) AS mean, count(*) AS held, any_value(lifetime) AS lifetime FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n, count(*) OVER (PARTITION BY event_type) AS lifetime FROM events) WHERE n <= 1000 GROUP BY 1")
def last_n_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = streams.last_samples(table(spark, sf_dir, "events"), "event_type", "event_id")
    return t.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("held"), F.first("lifetime").alias("lifetime"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.with_time(table(spark, sf_dir, "events"))


def _times(df: DataFrame) -> DataFrame:
    t = df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
    return t.withColumn("total", F.round("total", 4))


@query("tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator on a bounded table; tests hold a file stream against it."""
    return _times(streams.tumbling(_events(spark, sf_dir), "1 hour", "event_type"))


@query("sliding", "WITH s AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, event_type, value FROM events) SELECT start, start + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(streams.sliding(_events(spark, sf_dir), "1 hour", "30 minutes", "event_type"))


@query(
    "session",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
       s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY event_type, k""",
)
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(streams.sessions(_events(spark, sf_dir), "30 minutes", "event_type"))


@query("dedupe_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", first).where("n = 1").select("user_id", "event_id")
