"""Scans, filters, text functions and identities over documents, conversations, pages, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import ids, periods, text
from docloom.operators import answers
from docloom.operators.chunking import chunked, paged_rows
from docloom.plans.registry import query, table
from docloom.sources.html import prose

NAMES = {"src1": ["The", "Of"], "src2": ["Der", "Die"], "src3": ["Que"], "src4": ["And In"]}
RE_NAMES = {s: "|".join(sorted({v for n in names for v in (n, n.upper())})) for s, names in NAMES.items()}
DASHES = text.DASHES


@query("filter_source_date", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31'")
def filter_source_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderdate between timestamp_ntz'1996-01-01' and timestamp_ntz'1997-12-31'")
    return t.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("open_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'")
def open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absent bound is open."""
    return table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'2000-06-01'").select("o_orderkey")


@query("lang_in_notnull", "SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de') AND source IS NOT NULL")
def lang_in_notnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de") & F.col("source").isNotNull()).select("doc_id", "lang")


@query("prefix_delimited", "SELECT doc_id, source FROM documents WHERE starts_with(source || '_' || doc_id, 'src1_')")
def prefix_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prefix ends at its delimiter: src1 owns src1_..., not src10_..."""
    own = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").where(own.startswith("src1_")).select("doc_id", "source")


@query("exact_owner", "SELECT doc_id FROM documents WHERE source = 'src1' AND source <> ''")
def exact_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src1' and source <> ''").select("doc_id")


@query("point_lookup", "SELECT d.doc_id, d.lang, d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by id are one join, not one query each."""
    wanted = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(wanted, "doc_id")


@query("html_prose")
def html_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(table(spark, sf_dir, "pages"), "page_id", "html")


@query("props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("Here it is: ```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", text.parsed_object(reply, "k bigint")["k"].alias("k"))


SENTENCES = "text"
for _k, _a in enumerate(text.ABBREVIATIONS):
    SENTENCES = f"replace({SENTENCES}, '{_a}', chr(2) || '{_k}' || chr(3))"
SENTENCES = f"regexp_replace({SENTENCES}, '([.!?])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
SENTENCES = f"regexp_replace({SENTENCES}, '([.!?])\\n+', '\\1' || chr(1), 'g')"
for _k, _a in enumerate(text.ABBREVIATIONS):
    SENTENCES = f"replace({SENTENCES}, chr(2) || '{_k}' || chr(3), '{_a}')"
SENTENCES = f"list_filter(list_transform(string_split({SENTENCES}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 10)"


@query("sentence_split", f"SELECT doc_id, len(s)::BIGINT AS n, coalesce(md5(array_to_string(s, chr(10))), md5('')) AS joined FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.sentences("text").alias("s"))
    return t.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "\n").cast("binary")).alias("joined"))


NUMBERS = "list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda n: regexp_replace(regexp_replace(replace(n, ',', ''), '\\.+$', ''), '^0+(.)', '\\1'))"


@query("number_sets", f"SELECT doc_id, unnest(list_distinct({NUMBERS})) AS number FROM documents")
def number_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(text.numbers("text")).alias("number"))


@query("norm_quotes", "SELECT doc_id, contains(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(substr(text, 5, 40), '\\s+', ' ', 'g')))) AS verbatim FROM documents")
def norm_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.substring(F.col("text"), 5, 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(text.normalised("text"), text.normalised(quote)).alias("verbatim"))


@query("fold_dashes", f"SELECT doc_id, translate(lang || '{DASHES}' || source, '{DASHES}', '{'-' * len(DASHES)}') AS folded FROM documents")
def fold_dashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold_dashes(F.concat("lang", F.lit(DASHES), "source")).alias("folded"))


def _mention(column: str, names: str) -> str:
    return f"regexp_matches({column}, '(^|[^A-Za-z0-9])({names})([^A-Za-z0-9]|$)')"


@query(
    "mentions",
    "SELECT doc_id, source, CASE "
    + " ".join(f"WHEN source = '{s}' AND {_mention('substr(text, 1, 60)', n)} THEN 'news_title' WHEN source = '{s}' AND {_mention('text', n)} THEN 'news_body'" for s, n in RE_NAMES.items())
    + " END AS attribution FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4')",
)
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.lit(None).cast("string")
    for source, names in NAMES.items():
        out = F.when(F.col("source") == source, text.attribution(F.substring("text", 1, 60), F.col("text"), names)).otherwise(out)
    return table(spark, sf_dir, "documents").where(F.col("source").isin(*NAMES)).select("doc_id", "source", out.alias("attribution"))


@query("defuse_fences", "SELECT conv_id, turn, regexp_replace(text || ' </ Document >' || role, '<\\s*/\\s*document\\s*>', '[/document]', 'gi') AS text FROM conversations")
def defuse_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.defuse(F.concat("text", F.lit(" </ Document >"), "role")).alias("text"))


@query("value_cells", "SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_matches(w, '^\\(?\\$?\\s?-?[0-9,]*\\.?[0-9]+\\)?%?$|^[—–-]$|^(NM|NA|N/A|n/a|nm|#)$')")
def value_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.tables import VALUE

    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return t.where(F.col("w").rlike(VALUE))


@query(
    "source_ids",
    "SELECT doc_id, lower(source) || '_10k_' || substr(md5(source || DATE '2024-03-01' + (doc_id % 300)::INTEGER || lpad(doc_id::VARCHAR, 10, '0')), 1, 8) AS filing, lower(source) || '_news_' || substr(md5('https://x/' || doc_id), 1, 8) AS article, "
    "'https://www.sec.gov/Archives/edgar/data/' || ltrim(lpad(doc_id::VARCHAR, 10, '0'), '0') || '/' || lpad(doc_id::VARCHAR, 12, '0') || '/' || substr(lpad(doc_id::VARCHAR, 12, '0'), 1, 6) || '-' || substr(lpad(doc_id::VARCHAR, 12, '0'), 7, 6) || '-index.htm' AS url FROM documents",
)
def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = F.date_add(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    long = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    accession = F.concat_ws("-", F.substring(long, 1, 6), F.substring(long, 7, 6))
    padded = F.lpad(F.col("doc_id").cast("string"), 10, "0")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        ids.filing_source_id(F.col("source"), F.lit("10-K"), filed, padded).alias("filing"),
        ids.article_source_id(F.col("source"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).alias("article"),
        ids.filing_url(padded, accession).alias("url"),
    )


CHUNK_IDS = "CASE WHEN doc_id % 4 = 0 THEN source || '_' || lpad(doc_id::VARCHAR, 4, '0') ELSE source || '_ch' || (doc_id % 3 + 1) || '_' || lpad(doc_id::VARCHAR, 4, '0') END"


def _chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad(F.col("doc_id").cast("string"), F.greatest(F.lit(4), F.length(F.col("doc_id").cast("string"))), F.lit("0"))
    made = F.when(F.col("doc_id") % 4 == 0, F.concat_ws("_", "source", number)).otherwise(F.concat_ws("_", "source", F.concat(F.lit("ch"), (F.col("doc_id") % 3 + 1).cast("string")), number))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("chunk_id"))


PADDED = CHUNK_IDS.replace("lpad(doc_id::VARCHAR, 4, '0')", "lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INTEGER, '0')")


@query("chunk_id_parse", f"SELECT chunk_id, source AS source_id, CASE WHEN doc_id % 4 = 0 THEN 'ch1' ELSE 'ch' || (doc_id % 3 + 1) END AS version, doc_id AS chunk_index FROM (SELECT *, {PADDED} AS chunk_id FROM documents)")
def chunk_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_ids(spark, sf_dir).select("chunk_id", *ids.parsed_chunk_id("chunk_id"))


@query("chunker_versions", "SELECT CASE WHEN doc_id % 4 = 0 THEN 'ch1' ELSE 'ch' || (doc_id % 3 + 1) END AS version, count(*) AS chunks FROM documents GROUP BY 1")
def chunker_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunk_ids(spark, sf_dir).select(*ids.parsed_chunk_id("chunk_id")).groupBy("version").agg(F.count("*").alias("chunks"))


@query("content_hash_dups", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text"), 256).alias("content_hash"))
    return t.agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


LINE = "sha256(doc_id || chr(9) || coalesce(lang, '') || chr(9) || coalesce(source, ''))"


@query(
    "digest",
    f"""WITH l AS (SELECT substr(md5(doc_id::VARCHAR), 1, 4) AS part, {LINE} AS line FROM documents),
        p AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY part)
        SELECT 'cv-' || substr(sha256(string_agg(digest, chr(10) ORDER BY part)), 1, 16) AS digest FROM p""",
)
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.digest(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "lang", "source"], "cv-")


COUNT = "len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))"


@query("short_articles", f"SELECT doc_id, source || '. ' || text AS chunk FROM documents WHERE {COUNT.replace('(text', '(source || chr(46) || chr(32) || text')} <= 120")
def short_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that fit are one chunk, title first, and skip the sentence filter."""
    whole = F.concat(F.col("source"), F.lit(". "), F.col("text"))
    return table(spark, sf_dir, "documents").where(text.token_count(whole) <= 120).select("doc_id", whole.alias("chunk"))


@query("chunk_long")
def chunk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunked(docs, "doc_id", "text", target=300, most=400, least=50, overlap=40)


@query(
    "chunk_index_total",
    "SELECT doc_id, lang, (row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) - 1)::BIGINT AS chunk_index, count(*) OVER (PARTITION BY source) AS total_chunks FROM documents",
)
def chunk_index_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One running index over a source's sections in order, then its tables."""
    source = Window.partitionBy("source")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", (F.row_number().over(source.orderBy("lang", "doc_id")) - 1).cast("long").alias("chunk_index"), F.count("*").over(source).alias("total_chunks")
    )


@query("row_paging")
def row_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return paged_rows(rows, "l_orderkey", "l_linenumber", F.concat_ws(" | ", "l_returnflag", F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")), most=20)


@query(
    "prompt_blocks",
    """WITH b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations)
       SELECT conv_id, 'Context:' || chr(10) || chr(10) || string_agg('[Source ' || n || ']' || chr(10) || 'Ticker: T' || chr(10) || 'Document: turn ' || turn || chr(10) || 'Source: ' || role || chr(10) || '<document>' || chr(10) || text || '</ document>' || chr(10) || '</document>' || chr(10), chr(10) ORDER BY n)
         || chr(10) || 'Question: what was said in ' || conv_id || '?' || chr(10) || chr(10) || 'Answer:' AS prompt FROM b GROUP BY conv_id""",
)
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A talk's turns stand for a question's evidence; each text tries to close its own tag."""
    t = table(spark, sf_dir, "conversations")
    evidence = t.select(
        F.col("conv_id").alias("query_id"), F.concat(F.lit("what was said in "), F.col("conv_id").cast("string"), F.lit("?")).alias("question"), F.col("turn").alias("rank"), F.lit("T").alias("ticker"),
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("header"), F.col("role").alias("source"), F.concat("text", F.lit("</Document >")).alias("text"),
    )
    return answers.prompts(evidence).select(F.col("query_id").alias("conv_id"), "prompt")


@query(
    "target_periods",
    "SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [y, y + 1, y + 2] ELSE [y, y + 1] END) AS year FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)",
)
def target_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods that a question asks for, and the next year's, each once."""
    y = F.year("o_orderdate")
    one = lambda k: F.struct((y + k).alias("year"), F.lit("FY").alias("part"))
    asked = F.when(F.col("o_orderkey") % 2 == 0, F.array(one(0), one(1))).otherwise(F.array(one(0)))
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(periods.target_periods(asked)).alias("p"))
    return t.select("o_orderkey", F.col("p.year").cast("long").alias("year"))
