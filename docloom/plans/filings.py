"""Tables and sections of made-up filings, built from customers and orders by the same rules in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import rerank, sums, tables
from docloom.plans.registry import query, table
from docloom.sources.filings import cik, header_dates, sections


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each customer: a lead-in, a table of orders by year with a split dollar sign, and a layout table."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderkey", "o_totalprice")
    # A total half-way between whole numbers is added in order of orders, as its last digit decides.
    halfway = F.abs(F.abs(F.col("total")) % 1 - 0.5) < 1e-3
    o = sums.totals(orders, ["o_custkey", "y"], "o_totalprice", "o_orderkey", halfway).select("o_custkey", "y", F.col("rows").alias("n"), F.round("total").cast("long").alias("total"))
    last = o.groupBy("o_custkey").agg(F.max("y").alias("y1"))
    now = last.join(o, [last.o_custkey == o.o_custkey, last.y1 == o.y]).select(last.o_custkey, "y1", F.col("n").alias("n1"), F.col("total").alias("t1"))
    html = F.concat(
        F.lit("<p>Consolidated statements of C"), F.col("o_custkey").cast("string"), F.lit(" (in millions)</p><table><tr><td>only layout</td></tr></table><p>Orders</p><table><tr><td></td><td colspan=2>"),
        F.col("y1").cast("string"), F.lit("</td><td colspan=2>"), (F.col("y1") - 1).cast("string"),
        F.lit("</td></tr><tr><td>Count</td><td></td><td>"), F.col("n1").cast("string"), F.lit("</td><td></td><td>"), (F.col("n1") + 1).cast("string"),
        F.lit("</td></tr><tr><td>Total</td><td>$</td><td>"), F.col("t1").cast("string"), F.lit("</td><td>$</td><td>("), (F.col("t1") + 2).cast("string"), F.lit("</td><td>)</td></tr></table>"),
    )
    return now.select("o_custkey", html.alias("html"))


@query(
    "table_cells",
    """WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, round(sum(o_totalprice))::BIGINT AS total FROM orders GROUP BY 1, 2),
       l AS (SELECT o_custkey, max(y) AS y FROM o GROUP BY 1), p AS (SELECT * FROM l JOIN o USING (o_custkey, y))
       SELECT o_custkey, 1 AS index, 'Count' AS label, y::VARCHAR AS "column", n::VARCHAR AS value FROM p UNION ALL SELECT o_custkey, 1, 'Count', (y - 1)::VARCHAR, (n + 1)::VARCHAR FROM p
       UNION ALL SELECT o_custkey, 1, 'Total', y::VARCHAR, total::VARCHAR FROM p UNION ALL SELECT o_custkey, 1, 'Total', (y - 1)::VARCHAR, '(' || (total + 2) || ')' FROM p""",
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cells(tables.extracted(_pages(spark, sf_dir), "o_custkey", "html"), "o_custkey")


@query("table_facts", "SELECT DISTINCT o_custkey, 'Consolidated statements of C' || o_custkey || ' (in millions) Orders' AS title, 'in millions' AS units, 'reported' AS basis, true AS aligned FROM orders")
def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.extracted(_pages(spark, sf_dir), "o_custkey", "html")
    return t.select("o_custkey", *(F.col(f"table.{c}").alias(c) for c in ("title", "units", "basis", "aligned")))


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("FILED AS OF DATE: "), F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" CONFORMED PERIOD OF REPORT: "), F.date_format("o_orderdate", "yyyyMM"), F.lit("01"))).otherwise(""),
        F.lit(" CENTRAL INDEX KEY: "), F.lpad(key, 10, "0"), F.lit(" front Item 1. Business sells "), key, F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" ITEM 1A: Risk Factors many "), key)).otherwise(""),
        F.lit(" Item 7a.\nQuantitative "), key, F.lit(" Item 3 . Quantitative "), key, F.lit(" item 4: Controls "), key,
    )
    form = F.element_at(F.array(*map(F.lit, ("10-K", "10-K", "10-Q", "8-K"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", form.alias("form"), text.alias("text"))


@query("filing_headers", "SELECT o_orderkey, o_orderdate::DATE AS filed, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('month', o_orderdate)::DATE END AS period_end, nullif(ltrim(lpad(o_orderkey::VARCHAR, 10, '0'), '0'), '') AS cik FROM orders")
def filing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings(spark, sf_dir).select("o_orderkey", *header_dates("text"), cik("text").alias("cik"))


FILED = """WITH f AS (SELECT o_orderkey, o_orderkey % 4 AS form, o_orderkey % 3 > 0 AS risky, o_orderkey::VARCHAR AS k, 'FILED AS OF DATE: ' || strftime(o_orderdate, '%Y%m%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' CONFORMED PERIOD OF REPORT: ' || strftime(o_orderdate, '%Y%m') || '01' ELSE '' END
    || ' CENTRAL INDEX KEY: ' || lpad(o_orderkey::VARCHAR, 10, '0') || ' front ' AS head FROM orders),
  t AS (SELECT *, 'Item 1. Business sells ' || k AS one, 'ITEM 1A: Risk Factors many ' || k AS risk, 'Item 7a.' || chr(10) || 'Quantitative ' || k AS seven, 'Item 3 . Quantitative ' || k AS three, 'item 4: Controls ' || k AS four FROM f)"""


@query(
    "filing_sections",
    f"""{FILED} SELECT o_orderkey, 'item_1' AS name, one AS text FROM t WHERE form < 2 UNION ALL SELECT o_orderkey, 'item_1a', risk FROM t WHERE form < 2 AND risky
        UNION ALL SELECT o_orderkey, 'item_7a', seven || ' ' || three || ' ' || four FROM t WHERE form < 2 UNION ALL SELECT o_orderkey, 'item_3', three FROM t WHERE form = 2 UNION ALL SELECT o_orderkey, 'item_4', four FROM t WHERE form = 2
        UNION ALL SELECT o_orderkey, 'full_text', head || one || CASE WHEN risky THEN ' ' || risk ELSE '' END || ' ' || seven || ' ' || three || ' ' || four FROM t WHERE form = 3""",
)
def filing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of filings of three forms."""
    return _filings(spark, sf_dir).select("o_orderkey", F.explode(sections(F.col("text"), F.col("form"))).alias("s")).select("o_orderkey", "s.*")


@query("windows")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(rerank.windows("text")).alias("place", "window"))
