"""Periods, citations, sentiment and evaluation over orders, conversations, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import periods, text
from docloom.operators import citations, evaluation, sentiment
from docloom.plans.registry import query, table

# Orders stand for filings: every fifth is an annual report; customers are companies whose year ends in a month by nation.
FILINGS = """filings AS (SELECT o_orderkey, c_custkey, CASE WHEN o_orderkey % 5 = 0 THEN '10-K' WHEN o_orderkey % 5 < 4 THEN '10-Q' ELSE 'news' END AS doc_type,
    o_orderdate::DATE AS period_end, (c_nationkey % 12 + 1)::INTEGER AS m, CASE WHEN c_nationkey % 12 = 1 THEN 29 ELSE 28 END AS d FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _safe(y: str) -> str:
    return f"make_date({y}, m, least(d, day(last_day(make_date({y}, m, 1))))::BIGINT)"


LABELS = f"""labelled AS (SELECT *, CASE WHEN doc_type <> 'news' THEN CASE WHEN inside THEN y ELSE y + 1 END END AS fy,
    CASE WHEN doc_type = '10-K' THEN 'FY' WHEN doc_type = '10-Q' THEN 'Q' || greatest(1, least(3, round((period_end - (CASE WHEN inside THEN before ELSE this END)) / 91.3::DOUBLE)::INTEGER)) END AS part
    FROM (SELECT *, period_end <= this + 7 AS inside FROM (SELECT *, year(period_end) AS y, {_safe('year(period_end)')} AS this, {_safe('year(period_end) - 1')} AS before FROM filings)))"""


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 5
    return o.select(
        "o_orderkey", "c_custkey",
        F.when(k == 0, "10-K").when(k < 4, "10-Q").otherwise("news").alias("doc_type"),
        F.col("o_orderdate").cast("date").alias("period_end"),
        (F.col("c_nationkey") % 12 + 1).cast("int").alias("m"),
        F.when(F.col("c_nationkey") % 12 == 1, 29).otherwise(28).alias("d"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _filings(spark, sf_dir)
    return t.withColumn("label", periods.fiscal_label(F.col("doc_type"), F.col("period_end"), F.col("m"), F.col("d")))


@query("fiscal_label", f"WITH {FILINGS}, {LABELS} SELECT o_orderkey, fy, part FROM labelled")
def fiscal_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("o_orderkey", F.col("label.year").cast("long").alias("fy"), F.col("label.part").alias("part"))


@query("fye", f"WITH {FILINGS} SELECT c_custkey, month(max(period_end)) AS month, day(max(period_end)) AS day FROM filings WHERE doc_type = '10-K' GROUP BY 1")
def fye(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _filings(spark, sf_dir).where("doc_type = '10-K'").groupBy("c_custkey").agg(F.max("period_end").alias("e"))
    return t.select("c_custkey", F.month("e").cast("long").alias("month"), F.day("e").cast("long").alias("day"))


@query("period_end", f"WITH {FILINGS} SELECT o_orderkey, p.part, ({_safe('year(period_end)')} - p.days)::DATE AS ends FROM filings, (VALUES ('Q1', 274), ('Q2', 183), ('Q3', 91), ('FY', 0)) p(part, days)")
def period_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _filings(spark, sf_dir).withColumn("part", F.explode(F.array(*map(F.lit, ("Q1", "Q2", "Q3", "FY")))))
    return t.select("o_orderkey", "part", periods.expected_end(F.year("period_end"), F.col("part"), F.col("m"), F.col("d")).alias("ends"))


QUESTIONS = "SELECT o_orderkey, 'What was revenue in ' || CASE o_orderkey % 4 WHEN 0 THEN 'fiscal year ' || year(o_orderdate) WHEN 1 THEN 'the second quarter of FY' || substr(year(o_orderdate)::VARCHAR, 3, 2) WHEN 2 THEN 'Q4 and Q1 fiscal ' || year(o_orderdate) || ' or FY' || (year(o_orderdate) + 1) ELSE year(o_orderdate) || ' and ' || (year(o_orderdate) - 1) END AS q FROM orders"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    k = F.col("o_orderkey") % 4
    asked = (
        F.when(k == 0, F.concat(F.lit("fiscal year "), y))
        .when(k == 1, F.concat(F.lit("the second quarter of FY"), F.substring(y.cast("string"), 3, 2)))
        .when(k == 2, F.concat(F.lit("Q4 and Q1 fiscal "), y, F.lit(" or FY"), y + 1))
        .otherwise(F.concat(y, F.lit(" and "), y - 1))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("What was revenue in "), asked).alias("q"), y.alias("y"))


@query(
    "period_parse",
    """SELECT o_orderkey, array_to_string(CASE o_orderkey % 4 WHEN 0 THEN ['' || y || 'FY'] WHEN 1 THEN [(CASE WHEN y < 2000 THEN y + 100 ELSE y END) || 'Q2']
         WHEN 2 THEN [y || 'FY', y || 'Q1', (y + 1) || 'FY', (y + 1) || 'Q1'] ELSE [y || 'FY', (y - 1) || 'FY'] END, ' ') AS periods FROM (SELECT *, year(o_orderdate) AS y FROM orders)""",
)
def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-digit years are read as 20xx."""
    found = periods.requested_periods(F.col("q"), F.lit(12))
    t = _questions(spark, sf_dir).select("o_orderkey", found.alias("p"))
    return t.select("o_orderkey", F.array_join(F.transform("p", lambda p: F.concat(p["year"].cast("string"), p["part"])), " ").alias("periods"))


@query(
    "comparative_fallback",
    f"""WITH {FILINGS}, {LABELS}, have AS (SELECT DISTINCT c_custkey, fy, part, o_orderkey FROM labelled WHERE doc_type <> 'news'),
        want AS (SELECT c_custkey, y AS fy, 'FY' AS part FROM (SELECT c_custkey FROM customer), (VALUES (1996), (1998), (2000)) v(y)),
        own AS (SELECT w.c_custkey, w.fy, o_orderkey, false AS comparative FROM want w JOIN have h USING (c_custkey, fy, part)),
        next AS (SELECT w.c_custkey, w.fy, o_orderkey, true AS comparative FROM want w JOIN have h ON h.c_custkey = w.c_custkey AND h.fy = w.fy + 1 AND h.part = w.part WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.c_custkey = w.c_custkey AND o.fy = w.fy))
        SELECT c_custkey, fy::BIGINT AS fy, o_orderkey, comparative FROM (SELECT * FROM own UNION ALL SELECT * FROM next)""",
)
def comparative_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of the period asked for; where there is none, those of the next year, which report it beside their own."""
    have = _labelled(spark, sf_dir).where("doc_type <> 'news'").select("c_custkey", F.col("label.year").cast("long").alias("fy"), F.col("label.part").alias("part"), "o_orderkey")
    want = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*[F.lit(y).cast("long") for y in (1996, 1998, 2000)])).alias("fy"), F.lit("FY").alias("part"))
    own = want.join(have, ["c_custkey", "fy", "part"]).select("c_custkey", "fy", "o_orderkey", F.lit(False).alias("comparative"))
    missing = want.join(own, ["c_custkey", "fy"], "left_anti")
    later = have.withColumn("fy", F.col("fy") - 1)
    return own.union(missing.join(later, ["c_custkey", "fy", "part"]).select("c_custkey", "fy", "o_orderkey", F.lit(True)))


@query(
    "source_header",
    f"""WITH {FILINGS}, {LABELS} SELECT o_orderkey, CASE WHEN doc_type = 'news' THEN 'C' || c_custkey || ' news; published ' || (period_end + 30)
          ELSE 'C' || c_custkey || ' Form ' || doc_type || ' (' || CASE doc_type WHEN '10-K' THEN 'annual report' ELSE 'quarterly report' END || '); reporting period: ' || CASE part WHEN 'FY' THEN 'fiscal year ' || fy ELSE part || ' of fiscal year ' || fy END || ', ended ' || period_end || '; filed ' || (period_end + 30) END AS header FROM labelled""",
)
def source_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    company = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    return _labelled(spark, sf_dir).select("o_orderkey", periods.source_header(company, F.col("doc_type"), F.col("label"), F.col("period_end"), F.date_add("period_end", 30)).alias("header"))


PREMISES = ("What was the net loss", "Did operating losses fall", "Why did revenue rise", "What is the total", "Loss per share declined")


@query(
    "premise",
    """WITH q AS (SELECT o_orderkey, [%s][(o_orderkey %% 5 + 1)::INTEGER] AS q FROM orders),
       x AS (SELECT *, list_filter([CASE WHEN regexp_matches(q, '\\bnet\\s+loss(es)?\\b', 'i') THEN 'net income' END, CASE WHEN regexp_matches(q, '\\boperating\\s+loss(es)?\\b', 'i') THEN 'operating income' END,
         CASE WHEN regexp_matches(q, '\\bloss(es)?\\s+per\\s+share\\b', 'i') THEN 'earnings per share' END, CASE WHEN regexp_matches(q, '\\b(declin\\w*|fall|rise)\\b', 'i') THEN 'increased decreased compared with the prior year' END], lambda v: v IS NOT NULL) AS e FROM q)
       SELECT o_orderkey, CASE WHEN len(e) > 0 THEN q || ' (' || array_to_string(e, '; ') || ')' ELSE q END AS search FROM x"""
    % ", ".join(f"'{p}'" for p in PREMISES),
)
def premise(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, PREMISES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", periods.search_question(asked).alias("search"))


BASIS_QUESTIONS = ("pro‑forma revenue", "adjusted EBITDA and non–GAAP EPS", "managed care revenue", "constant currency growth on a managed basis")


@query("bases", "SELECT o_orderkey, ['PRO FORMA', 'NON-GAAP', 'reported', 'MANAGED BASIS,CONSTANT CURRENCY'][(o_orderkey % 4 + 1)::INTEGER] AS bases FROM orders")
def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.element_at(F.array(*map(F.lit, BASIS_QUESTIONS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(periods.requested_bases(text.fold_dashes(asked)), ",").alias("bases"))


@query("column_match")
def column_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _labelled(spark, sf_dir).where("doc_type <> 'news'")
    heading = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("period_end", "MMMM d, yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Three Months Ended "), F.date_format("period_end", "MMM d, yyyy"))).otherwise(F.col("label.year").cast("string"))
    t = t.withColumn("heading", heading)
    return t.select("o_orderkey", "heading", periods.column_matches(F.col("heading"), F.col("label.year"), F.col("label.part"), F.col("period_end")).alias("matches"))


# Conversations' turns stand for answers that cite the other turns of the same talk.
ANSWERS = "answers AS (SELECT conv_id, turn, text || ' [Source ' || (turn + 1) || '] more [Source 1] and [Source 99] [Source ' || (turn % 3 + 1) || ']' AS answer, ['a' || conv_id, 'b' || conv_id, 'c' || conv_id, 'd' || conv_id] AS sources FROM conversations)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat("text", F.lit(" [Source "), F.col("turn") + 1, F.lit("] more [Source 1] and [Source 99] [Source "), F.col("turn") % 3 + 1, F.lit("]"))
    sources = F.array(*(F.concat(F.lit(c), F.col("conv_id").cast("string")) for c in "abcd"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), sources.alias("sources"))


@query(
    "citation_resolve",
    f"""WITH {ANSWERS}, m AS (SELECT conv_id, turn, sources, unnest(regexp_extract_all(answer, '\\[Source ([0-9]+)\\]', 1)) AS marker, generate_subscripts(regexp_extract_all(answer, '\\[Source ([0-9]+)\\]', 1), 1) AS place FROM answers),
        f AS (SELECT conv_id, turn, marker::BIGINT AS marker, min(place) AS place, any_value(sources) AS sources FROM m WHERE marker::BIGINT BETWEEN 1 AND 4 GROUP BY 1, 2, 3)
        SELECT conv_id, turn, marker, dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY place) AS number, sources[marker] AS source FROM f""",
)
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _answers(spark, sf_dir).withColumn("id", F.struct("conv_id", "turn"))
    return citations.resolved(t, "id", "answer", "sources").select("id.*", "marker", "number", "source")


@query("citation_rewrite")
def citation_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", citations.rewritten("answer", "sources").alias("answer"))


NUMS = "list_distinct(list_transform(regexp_extract_all({}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda n: regexp_replace(regexp_replace(replace(n, ',', ''), '\\.+$', ''), '^0+(.)', '\\1')))"
WORDS = "list_distinct(list_filter(regexp_extract_all(lower(claim), '[a-z][a-z\\-]{4,}'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"


@query(
    "support_verdict",
    f"""WITH c AS (SELECT doc_id, text || ' ' || doc_id AS claim, CASE WHEN doc_id % 4 = 0 THEN [] WHEN doc_id % 4 = 1 THEN [text] ELSE [lang || source, doc_id::VARCHAR] END AS cited FROM documents),
        w AS (SELECT *, {WORDS} AS words, lower(array_to_string(cited, ' ')) AS src, {NUMS.format('claim')} AS nums FROM c),
        m AS (SELECT *, list_sort(list_filter(nums, lambda n: NOT list_contains({NUMS.format('src')}, n))) AS missing, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: contains(src, x)))::DOUBLE / len(words) ELSE 1 END AS overlap FROM w)
        SELECT doc_id, CASE WHEN len(cited) = 0 THEN 'uncited_claim' WHEN len(missing) > 0 THEN 'number_not_in_source' WHEN overlap < 0.4 THEN 'weak_overlap' ELSE 'supported_lexically' END AS verdict,
               array_to_string(CASE WHEN len(cited) = 0 THEN list_sort(nums) ELSE missing END, ' ') AS missing, CASE WHEN len(cited) > 0 THEN round(overlap, 2) END AS overlap FROM m WHERE len(cited) > 0 OR len(nums) > 0""",
)
def support_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    cited = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array("text")).otherwise(F.array(F.concat("lang", "source"), F.col("doc_id").cast("string")))
    claims = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")).alias("claim"), cited.alias("cited"))
    return citations.support(claims, ["doc_id"], "claim", "cited").withColumn("missing", F.array_join("missing", " "))


# Events stand for scored chunks: users are entities, days documents.
EVIDENCE = """ev AS (SELECT event_id, user_id % 40 AS entity, ts::DATE AS date, (user_id % 40) || '-' || (ts::DATE) AS source_id, event_id AS chunk_index, CASE event_type WHEN 'click' THEN 'item_7' WHEN 'view' THEN 'item_2' WHEN 'error' THEN 'risk_table' ELSE 'item_1a' END AS section,
    CASE WHEN event_type = 'signup' THEN 'news_body' WHEN event_id % 3 = 0 THEN 'news_title' ELSE 'filer' END AS attribution, (event_id % 21 - 10) / 10.0::DOUBLE AS score, (event_id % 5) / 4.0::DOUBLE AS confidence, event_id % 7 <> 0 AS reliable FROM events),
  el AS (SELECT *, max(date) OVER (PARTITION BY entity, source_id) AS doc_date FROM ev WHERE attribution IN ('filer', 'news_title') AND NOT ends_with(section, '_table'))"""
AS_OF = "2024-01-25"
PICKED = """pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, source_id ORDER BY CASE section WHEN 'item_7' THEN 0 WHEN 'item_2' THEN 1 WHEN 'item_1a' THEN 2 ELSE 9 END, chunk_index) AS place
    FROM (SELECT *, dense_rank() OVER (PARTITION BY entity ORDER BY doc_date DESC, source_id) AS doc_rank FROM el WHERE doc_date BETWEEN DATE '2024-01-25' - 30 AND DATE '2024-01-25')) WHERE doc_rank <= 8 AND place <= 2)"""
SIGNALS = """sg AS (SELECT entity, source_id, doc_date, CASE WHEN sum(confidence) > 0 THEN sum(score * confidence) / sum(confidence) ELSE avg(score) END AS score, avg(confidence) AS confidence FROM pk WHERE reliable GROUP BY ALL),
  wt AS (SELECT *, confidence * pow(0.5::DOUBLE, (DATE '2024-01-25' - doc_date) / 7.0::DOUBLE) AS weight FROM sg)"""
SENTIMENT = f"WITH {EVIDENCE}, {PICKED}, {SIGNALS}"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day, who, kind, k = F.col("ts").cast("date"), (F.col("user_id") % 40), F.col("event_type"), F.col("event_id")
    return e.select(
        k.alias("chunk_id"), who.alias("entity"), day.alias("date"), F.concat_ws("-", who.cast("string"), day.cast("string")).alias("source_id"), k.alias("chunk_index"),
        F.when(kind == "click", "item_7").when(kind == "view", "item_2").when(kind == "error", "risk_table").otherwise("item_1a").alias("section"),
        F.when(kind == "signup", "news_body").when(k % 3 == 0, "news_title").otherwise("filer").alias("attribution"),
        ((k % 21 - 10) / 10.0).alias("score"), ((k % 5) / 4.0).alias("confidence"), (k % 7 != 0).alias("reliable"),
    )


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("date")
    return sentiment.document_signals(sentiment.picked(_evidence(spark, sf_dir), as_of), as_of)


@query("topk_docs", f"WITH {EVIDENCE}, {PICKED} SELECT entity, source_id, event_id AS chunk_id, place::BIGINT AS place FROM pk")
def topk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.picked(_evidence(spark, sf_dir), F.lit(AS_OF).cast("date")).select("entity", "source_id", "chunk_id", F.col("place").cast("long").alias("place"))


@query("doc_scores", f"{SENTIMENT} SELECT entity, source_id, round(score, 6) AS score, round(confidence, 6) AS confidence, round(weight, 6) AS weight FROM wt")
def doc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("entity", "source_id", *(F.round(c, 6).alias(c) for c in ("score", "confidence", "weight")))


@query("ticker_score", f"{SENTIMENT} SELECT entity, round(CASE WHEN sum(weight) > 0 THEN sum(weight * score) / sum(weight) ELSE avg(round_even(score, 4)) END, 4) AS score, count(*) AS documents FROM wt GROUP BY 1")
def ticker_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.entity_scores(_signals(spark, sf_dir)).select("entity", F.round("score", 4).alias("score"), "documents")


@query(
    "status",
    f"""WITH {EVIDENCE}, {PICKED}, k AS (SELECT entity, max(doc_date) FILTER (WHERE doc_date <= DATE '2024-01-25') AS last FROM el GROUP BY 1),
        u AS (SELECT entity, count(*) AS total, count(*) FILTER (WHERE reliable) AS good, count(DISTINCT source_id) FILTER (WHERE reliable) AS used FROM pk GROUP BY 1)
        SELECT e.entity, CASE WHEN k.entity IS NULL THEN 'no_data' WHEN total IS NULL THEN 'stale' WHEN good < total THEN 'degraded' ELSE 'ok' END AS status,
               CASE WHEN good = 0 THEN 'full_extraction_failure' WHEN good < total THEN 'partial_extraction_failure' END AS reason, last AS last_document_date,
               coalesce(used, 0) AS documents_used, coalesce(good, 0)::BIGINT AS reliable_chunks, coalesce(total, 0)::BIGINT AS total_chunks
        FROM (SELECT DISTINCT entity FROM ev) e LEFT JOIN k USING (entity) LEFT JOIN u USING (entity)""",
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.status(_evidence(spark, sf_dir), F.lit(AS_OF).cast("date"))


@query(
    "summary_trend",
    f"""{SENTIMENT}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY doc_date DESC, source_id) AS n FROM wt),
        a AS (SELECT entity, avg(score) AS average, avg(score) FILTER (WHERE n <= 3) AS recent, (max(doc_date) - min(doc_date))::BIGINT AS period_days, count(*) AS documents FROM n GROUP BY 1)
        SELECT entity, round(average, 6) AS average, CASE WHEN documents < 3 THEN 'stable' WHEN recent > average + 0.1 THEN 'improving' WHEN recent < average - 0.1 THEN 'declining' ELSE 'stable' END AS trend, period_days, documents FROM a""",
)
def summary_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.summary(_signals(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query(
    "coverage_gaps",
    """WITH c AS (SELECT o_custkey, min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date, list_sort(list(DISTINCT year(o_orderdate))) AS years FROM orders GROUP BY 1)
       SELECT o_custkey, first_date, last_date, array_to_string(years, ',') AS years, array_to_string(list_filter(range(year(first_date), year(last_date) + 1), lambda y: NOT list_contains(years, y)), ',') AS missing FROM c""",
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    c = sentiment.coverage(t, ["o_custkey"], "day")
    return c.select("o_custkey", "first_date", "last_date", *(F.array_join(F.col(x).cast("array<string>"), ",").alias(x) for x in ("years", "missing")))


@query("nan_clamp", "SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2) THEN NULL ELSE greatest(-1, least(1, value / 50 - 1)) END AS score FROM events")
def nan_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 10
    raw = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("value") / 50 - 1)
    return table(spark, sf_dir, "events").select("event_id", text.clamped(raw, -1.0, 1.0).alias("score"))


# Rankings: BM25's batch stands for what was retrieved, benchmark passages in texts for what is relevant.
JUDGED = "j AS (SELECT (user_id % 50) AS query_id, event_id AS doc_id, row_number() OVER (PARTITION BY user_id % 50 ORDER BY value DESC, event_id) AS rank FROM events), r AS (SELECT DISTINCT user_id % 50 AS query_id, event_id AS doc_id FROM events WHERE event_type = 'purchase' AND user_id % 50 <> 3)"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").withColumn("query_id", F.col("user_id") % 50)
    best = Window.partitionBy("query_id").orderBy(F.col("value").desc(), "event_id")
    judged = e.select("query_id", F.col("event_id").alias("doc_id"), F.row_number().over(best).alias("rank"))
    return judged, e.where("event_type = 'purchase' and query_id <> 3").select("query_id", F.col("event_id").alias("doc_id"))


MARKED = f"WITH {JUDGED}, m AS (SELECT j.*, r.doc_id IS NOT NULL AS rel FROM j LEFT JOIN r USING (query_id, doc_id)), n AS (SELECT query_id, count(*) AS n_rel FROM r GROUP BY 1)"
NDCG = "coalesce(sum(CASE WHEN rel AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / nullif(list_sum(list_transform(range(1, least(coalesce(any_value(n_rel), 0), count(*) FILTER (WHERE rank <= {k})) + 1), lambda i: 1 / log2(i + 1))), 0), 0)"
RANKS = f"{MARKED}, q AS (SELECT query_id, coalesce(1.0::DOUBLE / min(CASE WHEN rel THEN rank END), 0) AS rr, max((rel AND rank <= 1)::INTEGER)::DOUBLE AS h1, max((rel AND rank <= 10)::INTEGER)::DOUBLE AS h10, {NDCG.format(k=5)} AS n5, {NDCG.format(k=10)} AS n10 FROM m LEFT JOIN n USING (query_id) GROUP BY query_id)"


@query("mrr", f"{RANKS} SELECT query_id, round(rr, 6) AS reciprocal_rank FROM q")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranking(*_judged(spark, sf_dir)).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query("ndcg", f"{RANKS} SELECT query_id, round(n5, 6) AS ndcg_at_5, round(n10, 6) AS ndcg_at_10 FROM q")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranking(*_judged(spark, sf_dir)).select("query_id", F.round("ndcg_at_5", 6).alias("ndcg_at_5"), F.round("ndcg_at_10", 6).alias("ndcg_at_10"))


@query("hit_at_k", f"{RANKS} SELECT round(avg(rr), 6) AS mrr, round(avg(h1), 6) AS hit_at_1, round(avg(h10), 6) AS hit_at_10, round(avg(n10), 6) AS ndcg_at_10, count(*) AS queries FROM q")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluation.ranking(*_judged(spark, sf_dir))
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return t.agg(mean("reciprocal_rank", "mrr"), mean("hit_at_1", "hit_at_1"), mean("hit_at_10", "hit_at_10"), mean("ndcg_at_10", "ndcg_at_10"), F.count("*").alias("queries"))


# Classification: an expected and a predicted direction for every event.
DIRECTION = "CASE WHEN {x} >= 0.1 THEN 'positive' WHEN {x} <= -0.1 THEN 'negative' ELSE 'neutral' END"
RECORDS = f"p AS (SELECT event_id, user_id % 3 AS split, {DIRECTION.format(x='(value / 50 - 1)')} AS truth, {DIRECTION.format(x='((event_id % 21 - 10) / 10.0)')} AS said, (event_id % 21 - 10) / 10.0 < -0.3 AS blocked, value / 50 - 1 < -0.3 AS should FROM events)"
LABEL_SET = ("positive", "neutral", "negative")
F1 = "CASE WHEN count(*) FILTER (WHERE truth = '{l}') + count(*) FILTER (WHERE said = '{l}') > 0 THEN 2.0::DOUBLE * count(*) FILTER (WHERE truth = '{l}' AND said = '{l}') / (count(*) FILTER (WHERE truth = '{l}') + count(*) FILTER (WHERE said = '{l}')) ELSE 0 END"
MACRO = "(" + " + ".join(F1.format(l=x) for x in LABEL_SET) + ") / 3"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = (F.col("event_id") % 21 - 10) / 10.0
    truth = F.col("value") / 50 - 1
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 3).alias("split"), text.direction(truth).alias("truth"), text.direction(said).alias("said"), (said < -0.3).alias("blocked"), (truth < -0.3).alias("should"))


@query("confusion", f"WITH {RECORDS} SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE said = '{x}') AS {x}" for x in LABEL_SET) + " FROM p GROUP BY truth")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("truth").pivot("said", list(LABEL_SET)).count().na.fill(0)


@query("gate_matrix", f"WITH {RECORDS} SELECT count(*) FILTER (WHERE blocked AND should) AS right_block, count(*) FILTER (WHERE blocked AND NOT should) AS false_block, count(*) FILTER (WHERE NOT blocked AND should) AS false_pass, count(*) FILTER (WHERE NOT blocked AND NOT should) AS right_pass, count(*) FILTER (WHERE truth = 'positive' AND said = 'negative' OR truth = 'negative' AND said = 'positive') AS wrong_sign FROM p")
def gate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, s = F.col("blocked"), F.col("should")
    wrong = (F.col("truth") == "positive") & (F.col("said") == "negative") | (F.col("truth") == "negative") & (F.col("said") == "positive")
    return _records(spark, sf_dir).agg(F.count_if(b & s).alias("right_block"), F.count_if(b & ~s).alias("false_block"), F.count_if(~b & s).alias("false_pass"), F.count_if(~b & ~s).alias("right_pass"), F.count_if(wrong).alias("wrong_sign"))


@query("macro_f1", f"WITH {RECORDS} SELECT round({MACRO}, 6) AS macro_f1 FROM p")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).agg(F.round(evaluation.macro_f1(F.col("truth"), F.col("said"), LABEL_SET), 6).alias("macro_f1"))


@query("split_rollup", f"WITH {RECORDS} SELECT coalesce(split::VARCHAR, 'all') AS split, count(*) AS n, round({MACRO}, 6) AS macro_f1 FROM p GROUP BY ROLLUP (split)")
def split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _records(spark, sf_dir).rollup("split").agg(F.count("*").alias("n"), F.round(evaluation.macro_f1(F.col("truth"), F.col("said"), LABEL_SET), 6).alias("macro_f1"))
    return t.select(F.coalesce(F.col("split").cast("string"), F.lit("all")).alias("split"), "n", "macro_f1")


@query("gate_changes", f"WITH {RECORDS} SELECT event_id, blocked AS before, should AS after FROM p WHERE blocked <> should")
def gate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return r.select("event_id", F.col("blocked").alias("before")).join(r.select("event_id", F.col("should").alias("after")), "event_id").where("before <> after")


# Prices: the mean value of events of each type and day.
PRICES = "px AS (SELECT event_type, ts::DATE AS day, round(avg(value), 4) AS price FROM events GROUP BY 1, 2)"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 4).alias("price"))


FORWARD = f"WITH {PRICES}, fw AS (SELECT event_type, day, round_even((lead(price, 5) OVER w - price) / price, 4) AS forward FROM px WINDOW w AS (PARTITION BY event_type ORDER BY day))"


@query("fwd_return", f"{FORWARD} SELECT event_type, day, forward FROM fw")
def fwd_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.forward_return(_prices(spark, sf_dir), "event_type", "day", "price").select("event_type", "day", "forward")


@query("asof_forward", "WITH c AS (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'purchase' AND dayofweek(ts) NOT IN (0, 6)), e AS (SELECT event_id, ts::DATE AS day FROM events) SELECT event_id, e.day, min(c.day) AS trading_day FROM e LEFT JOIN c ON c.day BETWEEN e.day AND e.day + 5 GROUP BY 1, 2")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    calendar = e.where("event_type = 'purchase'").where(~F.dayofweek("day").isin(1, 7)).select("day")
    return evaluation.first_within(e.select("event_id", "day"), calendar)


SIGNED = "CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN forward ELSE -forward END"


@query("sharpe", f"{FORWARD} SELECT event_type, round(avg({SIGNED}) / nullif(stddev_samp({SIGNED}), 0), 6) AS sharpe FROM fw GROUP BY 1")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluation.forward_return(_prices(spark, sf_dir), "event_type", "day", "price")
    signed = F.when(F.col("event_type").isin("purchase", "signup", "click"), F.col("forward")).otherwise(-F.col("forward"))
    return t.groupBy("event_type").agg(F.round(evaluation.sharpe(signed), 6).alias("sharpe"))


@query("accuracy_coverage", f"WITH {RECORDS}, a AS (SELECT CASE WHEN said <> 'neutral' THEN (said = truth)::INTEGER END AS correct FROM p) SELECT round(avg(correct), 6) AS accuracy, round(count(correct)::DOUBLE / count(*), 6) AS coverage, count(*) AS n FROM a")
def accuracy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral predictions are neither right nor wrong."""
    t = _records(spark, sf_dir).select(F.when(F.col("said") != "neutral", (F.col("said") == F.col("truth")).cast("int")).alias("correct"))
    return t.agg(F.round(F.avg("correct"), 6).alias("accuracy"), F.round(F.count("correct") / F.count("*"), 6).alias("coverage"), F.count("*").alias("n"))


@query("return_by_label", f"{FORWARD} SELECT event_type, round(avg(forward), 6) AS mean_return, count(forward) AS n FROM fw GROUP BY 1")
def return_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = evaluation.forward_return(_prices(spark, sf_dir), "event_type", "day", "price")
    return t.groupBy("event_type").agg(F.round(F.avg("forward"), 6).alias("mean_return"), F.count("forward").alias("n"))


@query("budget_running", "SELECT user_id, event_id FROM (SELECT *, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) WHERE spent <= 30000")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in order while the running cost stays within each user's cap."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, sf_dir, "events").withColumn("spent", F.sum(F.round(F.col("value") * 100).cast("long")).over(w))
    return t.where("spent <= 30000").select("user_id", "event_id")
