from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.engine import Config, Engine
from docloom.operators import rerank, tables
from docloom.operators.chunking import Limits
from docloom.sources import feeds, filings

SHAPE = "ticker string, doc_type string, date string, url string, text string, period_end string, attribution string"


def documents(spark, rows):
    df = spark.createDataFrame(rows, SHAPE)
    return df.withColumn("date", F.to_date("date")).withColumn("period_end", F.to_date("period_end"))


ROWS = [
    ("AAA", "news", "2024-01-10", "u1", "Alpha had record growth in widgets this year. Strong profit was reported again.", None, "news_title"),
    ("AAA", "news", "2024-01-12", "u2", "Alpha opened a new plant for widgets in Ohio. Nothing else happened there.", None, "news_title"),
    ("BBB", "10-K", "2024-02-01", "u3", "Beta saw a loss and a decline of sales. The lawsuit over pumps goes on.", "2023-12-31", "filer"),
]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", Config(limits=Limits(target=12, most=20, least=1, overlap=0)))
    e.ingest(documents(spark, ROWS))
    return e


def test_questions_find_their_evidence(engine):
    got = engine.query("How did widgets growth go?").collect()
    assert "record growth" in got[0].excerpt
    assert got[0].header == "AAA news; published 2024-01-10"
    assert all("Beta" in r.excerpt or "lawsuit" in r.excerpt for r in engine.query("What about the pumps?", ticker="BBB").collect())
    assert engine.query("What about widgets?", date_from="2030-01-01").count() == 0
    with pytest.raises(ValueError, match="characters"):
        engine.query("hi")


def test_ingest_replaces_a_source_and_keeps_the_rest(engine, spark):
    before = engine.chunks().count()
    engine.ingest(documents(spark, [("AAA", "news", "2024-01-13", "u1", "Alpha now says something short but new.", None, "news_title")]))
    texts = [r.text for r in engine.chunks().collect()]
    assert any("something short" in t for t in texts) and not any("record growth" in t for t in texts)
    assert any("Ohio" in t for t in texts) and len(texts) < before
    engine.ingest(documents(spark, ROWS[1:2]))
    assert sorted(r.text for r in engine.chunks().collect()) == sorted(texts)
    assert engine.store.manifest()["version"] == 2


def test_sentiment_coverage_and_health(engine):
    s = {r.entity: r for r in engine.sentiment("2024-02-05").collect()}
    assert s["AAA"].score > 0 > s["BBB"].score
    assert engine.health().first().status == "healthy"
    assert {(r.ticker, r.doc_type) for r in engine.coverage().collect()} == {("AAA", "news"), ("BBB", "10-K")}


def test_a_period_asked_for_keeps_its_passages_and_tables(spark, tmp_path):
    """Other periods' filings, closer in words, fill the candidates; the named period's prose and statement still come."""
    page = lambda y: f"<p>Consolidated Statements of Income</p><table><tr><td></td><td>Year Ended December 31, {y}</td><td>Year Ended December 31, {y - 1}</td></tr><tr><td>Sales</td><td>{y}1</td><td>{y}2</td></tr><tr><td>Costs</td><td>5</td><td>4</td></tr></table>"
    rows = [("CCC", "10-K", f"{y + 1}-02-01", f"k{y}", f"Revenue growth of fiscal year 2016 and revenue growth again, told in {y}.", f"{y}-12-31", "filer", page(y)) for y in range(2017, 2024)]
    rows.append(("CCC", "10-K", "2017-02-01", "k2016", "Pumps sold well in the north.", "2016-12-31", "filer", page(2016)))
    df = spark.createDataFrame(rows, f"{SHAPE}, html string").withColumn("date", F.to_date("date")).withColumn("period_end", F.to_date("period_end"))
    e = Engine(spark, f"file://{tmp_path}/p", Config(limits=Limits(target=40, most=200, least=1, overlap=0), candidates=2, top_k=20, table_slots=10))
    e.ingest(df)
    assert {(r.source_id, r.chunk_index): r.section for r in e.chunks().collect() if r.section}.keys() == {(r.source_id, 1) for r in e.chunks().collect()}
    got = e.query("How did revenue growth go in fiscal year 2016?", ticker="CCC").collect()
    assert any("Pumps" in r.excerpt and not r.is_table for r in got)
    tables_ = {r.header.split("ended ")[1][:4] for r in got if r.is_table}
    assert tables_ == {"2016", "2017"}
    own = e.query("How did revenue growth go in fiscal year 2015?", ticker="CCC").collect()
    assert {r.header.split("ended ")[1][:4] for r in own if r.is_table} == {"2016"} and any("Pumps" in r.excerpt for r in own)


def test_filing_tree(spark, tmp_path):
    for path, text in {
        "AAA/10-K/001/a.txt": "FILED AS OF DATE: 20240201\nCONFORMED PERIOD OF REPORT: 20231231\nCENTRAL INDEX KEY: 0000012345",
        "AAA/10-K/001/primary-document.html": "FILED AS OF DATE: 20240202\n",
        "AAA/10-K/002/x.txt": "no header",
    }.items():
        f = tmp_path / "tree" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = filings.filings(spark, f"{tmp_path}/tree").collect()
    assert [(r.ticker, r.form, r.accession, str(r.filed), r.period_end, r.cik) for r in got] == [("AAA", "10-K", "001", "2024-02-02", None, None)]


def test_articles(spark):
    long = "Meta did something that takes quite a few words to say at length."
    rows = [(0, 1, "Meta up", "l1", "2024-01-10", None, long, None, None), (0, 2, "again", "l1", "2024-01-10", None, long, None, None), (1, 1, "Other", "l2", None, "2024-01-09", "", f"<p>{long}</p>", None), (1, 2, "Meta", "l3", None, None, long, None, None), (1, 3, "Meta", "l4", "2020-01-01", None, long, None, None), (1, 4, "Meta", "l5", "2024-01-10", None, "short", None, None)]
    df = spark.createDataFrame(rows, "source int, at int, title string, link string, published string, updated string, summary string, content string, description string")
    got = {(r.url, r.attribution) for r in feeds.articles(df, ["Meta"], "2024-01-15").collect()}
    assert got == {("l1", "news_title"), ("l2", "news_body")}


def test_golden_sets_are_refused_unless_annotated(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": 1, "query": "q", "relevant_chunk_ids": ["a"]}, {"id": 2, "question": "r", "relevant_chunk_ids": []}]')
    assert [r.question for r in feeds.golden_set(spark, str(tmp_path / "g.json")).orderBy("id").collect()] == ["q", "r"]
    (tmp_path / "h.json").write_text('[{"id": 1, "question": "q", "relevant_chunk_ids": []}]')
    with pytest.raises(ValueError, match="annotated"):
        feeds.golden_set(spark, str(tmp_path / "h.json"))


PAGE = """<p>Consolidated Statements of Income</p><table><tr><td></td><td colspan="4">(In millions) Year Ended June 30,</td></tr>
<tr><td></td><td colspan="2">2024</td><td colspan="2">2023</td></tr><tr><td>Revenue</td><td>$</td><td>245</td><td>$</td><td>211</td></tr>
<tr><td>Loss</td><td></td><td>(3</td><td>)</td><td>(2)</td></tr><tr><td>Margin</td><td></td><td>12</td><td>%</td><td>11%</td><td>(a)</td></tr></table><p>after</p>"""


def test_tables_are_parsed_and_rendered():
    (t,) = tables.extract(PAGE)
    assert (t["title"], t["units"], t["basis"], t["aligned"]) == ("Consolidated Statements of Income", "In millions", "reported", True)
    assert t["columns"] == ["Year Ended June 30, 2024", "Year Ended June 30, 2023"]
    assert [(r["label"], [c["value"] for c in r["cells"]]) for r in t["rows"]] == [("Revenue", ["245", "211"]), ("Loss", ["(3)", "(2)"]), ("Margin", ["12%", "11%"])]
    pages = tables.render(t, "AAA 10-K", 60)
    assert len(pages) > 1 and all("Columns: Year Ended June 30, 2024" in p for p in pages)
    assert tables.extract("<table><tr><td>menu</td></tr></table>") == [] == tables.extract(None)


@pytest.mark.parametrize(
    ("lead", "headers", "footnotes", "labels", "expected"),
    [
        ("Consolidated balance sheets", "2024", "", "", "reported"),
        ("Non‑GAAP results", "2024", "", "", "NON-GAAP"),
        ("", "Reported Pro forma", "", "", "MIXED (reported and PRO FORMA columns)"),
        ("", "2024", "shown on a managed basis", "", "MIXED (footnote marks some figures MANAGED BASIS)"),
        ("", "2024", "", "Revenue at constant currency", "CONSTANT CURRENCY"),
        ("", "2024", "", "", "not stated"),
    ],
)
def test_bases(lead, headers, footnotes, labels, expected):
    assert tables.table_basis(lead, headers, footnotes, labels) == expected


def plain_windows(text, words=150):
    """The rule of half-overlapping windows, one word at a time."""
    if len(text.split()) <= words:
        return [text]
    parts = [p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])", text) if p.strip()]
    out, at = [], 0
    while True:
        held, n = [], 0
        for p in parts[at:]:
            if held and n + len(p.split()) > words:
                break
            held.append(p)
            n += len(p.split())
        out.append(" ".join(held))
        if at + len(held) >= len(parts):
            return out
        at += max(1, len(held) // 2)


def test_windows_equal_the_rule(spark):
    r = random.Random(5)
    texts = ["", "short one.", "no capitals. follow. here " * 60]
    for _ in range(300):
        texts.append(" ".join(f"{'W' if r.random() < 0.8 else 'w'}{'w ' * r.choice([1, 1, 3, 20, 60, 100, 170])}end{r.choice('.!?')}" for _ in range(r.randint(1, 14))))
    got = {x.i: x.w for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", rerank.windows("t").alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_windows(t) for t in texts]
    parts = ["A " * 79 + "a.", "B " * 59 + "b.", "C " * 99 + "c.", "D " * 9 + "d."]
    assert max(len(w.split()) for w in rerank.half_overlapping(parts)) <= 150
    assert rerank.half_overlapping([]) == []


def test_row_windows_keep_wanted_columns(spark):
    text = "ctx\nTable: T\nUnits: m\nBasis: reported\nColumns: 2024 | 2024 pro forma\nRevenue: 2024 = 5; 2024 pro forma = 4\nCost: 2023 = 1"
    of = lambda *wanted: spark.range(1).select(rerank.row_windows(F.lit(text), F.array(*map(F.lit, wanted)).cast("array<string>")).alias("w")).first().w
    assert of("2024") == ["Table: T (Units: m): Revenue: 2024 = 5"]
    assert of() == ["Table: T (Units: m): Revenue: 2024 = 5; 2024 pro forma = 4", "Table: T (Units: m): Cost: 2023 = 1"]
    assert of("1999") == [text]


ROWS_OF_TWO = "<table><tr><td>Sales</td><td>12</td><td>10</td></tr><tr><td>Costs</td><td>7</td><td>6</td></tr></table>"


def test_basis_reads_what_belongs_to_the_table():
    first, second = tables.extract(f"<p>INC OME STATEMENTS</p>{ROWS_OF_TWO}<p>Following are the unaudited pro forma results:</p>{ROWS_OF_TWO}")
    assert (first["basis"], second["basis"]) == ("reported", "PRO FORMA")
    (plain,) = tables.extract(f"<p>Results</p>{ROWS_OF_TWO}<p>Following is a pro forma table:</p>")
    assert plain["basis"] == "not stated"
    (noted,) = tables.extract(f"<p>Extra results:</p>{ROWS_OF_TWO}<p>(a) These pro forma results are estimates.</p>")
    assert noted["basis"] == "MIXED (footnote marks some figures PRO FORMA)"
    (kept,) = tables.extract(f"<p>Consolidated balance sheets</p>{ROWS_OF_TWO}<p>(a) Non-GAAP figures too.</p>")
    assert kept["basis"] == "reported" and "footnote marks some figures NON-GAAP" in kept["evidence"]
    assert tables.table_basis("Amounts are reported in the balance sheets as follows:", "") == "not stated"


OFFSET = """<p>Highlights (in millions)</p><table><tr><td colspan="3"></td><td colspan="9">Six months ended June 30,</td></tr>
<tr><td>2Q26</td><td>1Q26</td><td>2026</td><td>2025</td></tr>
<tr><td colspan="6">Net revenue</td><td>$</td><td>57,347</td><td>$</td><td>49,836</td><td>$</td><td>107,183</td><td>$</td><td>90,222</td></tr>
<tr><td colspan="6">Expenses</td></tr>
<tr><td colspan="6">Net income</td><td></td><td>(1,234</td><td>)</td><td>5</td><td></td><td>6</td><td></td><td>7</td></tr></table>"""


def test_grids_that_do_not_line_up_are_matched_in_order():
    (t,) = tables.extract(OFFSET)
    assert t["aligned"] and t["columns"] == ["2Q26", "1Q26", "Six months ended June 30, 2026", "Six months ended June 30, 2025"]
    assert [(r["label"], [c["value"] for c in r["cells"]]) for r in t["rows"]] == [("Net revenue", ["57,347", "49,836", "107,183", "90,222"]), ("Expenses", []), ("Net income", ["(1,234)", "5", "6", "7"])]
    assert t["units"] == "in millions"
    page = tables.render(t, "ctx", 400)[0]
    assert "\nExpenses:\n" in page and "Net income: 2Q26 = (1,234); 1Q26 = 5" in page


def test_tables_in_layout_tables_and_unmatched_ones():
    (t,) = tables.extract(f"<table><tr><td>menu</td><td>{ROWS_OF_TWO}</td></tr></table>")
    assert [r["label"] for r in t["rows"]][-2:] == ["Sales", "Costs"]
    (u,) = tables.extract("<table><tr><td></td><td>2024</td></tr><tr><td>Rate</td><td>5</td><td>SOFR + 3</td><td>6</td></tr><tr><td>Sum</td><td>1</td><td></td><td>2</td></tr></table>")
    assert not u["aligned"] and u["columns"] == [] and "Rate: 5 | SOFR + 3 | 6" in tables.render(u, "", 400)[0]
    assert "NOT ALIGNED" in tables.render(u, "", 400)[0]
    assert tables.marked_text(f"<p>a</p>{ROWS_OF_TWO}<table><tr><td>x</td></tr></table><p>b</p>") == "a [[TABLE 0]] b"


def test_tables_get_the_section_they_stand_in(spark):
    html = f"<p>Item 7. Management's view</p>{ROWS_OF_TWO}<p>Item 8. Financial statements</p>{ROWS_OF_TWO}{ROWS_OF_TWO}"
    df = spark.createDataFrame([(1, html, "10-K"), (2, ROWS_OF_TWO, "8-K")], "id int, html string, form string")
    got = sorted((r.id, r.table["index"], r.section) for r in tables.with_sections(df, "id", "html", "form").collect())
    assert got == [(1, 0, "item_7"), (1, 1, "item_8"), (1, 2, "item_8"), (2, 0, "full_text")]


def test_sections_of_each_form(spark):
    text = "x Item 1. Description a Item 1A: Risk Factors b ITEM 7a.\n Quantitative c Item 3. Quantitative d Item 4. Controls e"
    df = spark.createDataFrame([(f, text) for f in ("10-K", "10-Q", "DEF 14A")] + [("10-K", "Item 8. Financial statements only")], "form string, text string")
    got = [[(s.name, s.text) for s in r.s] for r in df.select(filings.sections(F.col("text"), F.col("form")).alias("s")).collect()]
    assert [n for n, _ in got[0]] == ["item_1", "item_1a", "item_7a"] and got[0][2][1].endswith("Controls e")
    assert got[1] == [("item_3", "Item 3. Quantitative d"), ("item_4", "Item 4. Controls e")]
    assert got[2] == [("full_text", text)] and got[3][0][0] == "full_text"


def test_health_sees_vectors_of_other_texts(engine, spark):
    held = engine.chunks()
    assert engine.health().first().dense_mode == "full"
    first = held.select(F.min("chunk_id")).first()[0]
    stale = held.withColumn("vector_hash", F.when(F.col("chunk_id") == first, "other").otherwise(F.col("vector_hash")))
    engine.store.publish(stale, "chunk_id", ["ticker"])
    h = engine.health().first()
    assert (h.mismatched, h.dense_mode, h.status) == (1, "partial", "degraded")
    engine.ingest(documents(spark, ROWS))
    assert engine.health().first().status == "healthy"


def test_a_broken_manifest_leaves_the_version_before(engine, tmp_path):
    root = Path(engine.store.root.removeprefix("file://"))
    n = engine.chunks().count()
    (root / "manifest-99.json").write_text('{"version": 7')
    (root / "manifest.new").write_text("{")
    assert engine.chunks().count() == n
    (root / "manifest-98.json").write_text('{"version": 55, "previous": null, "rows": 1}')
    assert engine.chunks().count() == n

