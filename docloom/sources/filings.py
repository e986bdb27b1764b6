"""Filings on a shared file system: the directory tree, headers, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER_CHARS, CIK_CHARS = 4000, 6000
#: Sections by the items that open them, in filings of each form.
SECTIONS = {
    "10-K": (
        ("item_1", r"(?i)item\s+1[.\s:]+(?:business|description)"),
        ("item_1a", r"(?i)item\s+1a[.\s:]+risk\s+factors"),
        ("item_7", r"(?i)item\s+7[.\s:]+management"),
        ("item_7a", r"(?i)item\s+7a[.\s:]+quantitative"),
        ("item_8", r"(?i)item\s+8[.\s:]+financial\s+statements"),
    ),
    "10-Q": (
        ("item_1", r"(?i)item\s+1[.\s:]+financial\s+statements"),
        ("item_2", r"(?i)item\s+2[.\s:]+management"),
        ("item_3", r"(?i)item\s+3[.\s:]+quantitative"),
        ("item_4", r"(?i)item\s+4[.\s:]+controls"),
    ),
}


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(ticker, form, accession, path, text): of each {ticker}/{form}/{accession} folder one file, primary documents first, then .txt, then .htm."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root)
    path = F.col("path")
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    rank = F.when(name.startswith("primary-document."), 0).when(name.endswith(".txt"), 1).when(name.rlike(r"\.htm"), 2)
    t = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    t = t.select(F.element_at(parts, -4).alias("ticker"), F.element_at(parts, -3).alias("form"), F.element_at(parts, -2).alias("accession"), "path", "text", rank.alias("rank"), name.alias("name"))
    first = Window.partitionBy("ticker", "form", "accession").orderBy("rank", "name")
    return t.where("rank is not null").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "rank", "name")


def header_dates(text: str | Column) -> list[Column]:
    """filed and period_end from the header; a period is never made up."""
    head = F.substring(text, 1, HEADER_CHARS)
    date = lambda key: F.try_to_date(F.nullif(F.regexp_extract(head, rf"{key}:\s*(\d{{8}})", 1), F.lit("")), "yyyyMMdd")
    return [date("FILED AS OF DATE").alias("filed"), date("CONFORMED PERIOD OF REPORT").alias("period_end")]


def cik(text: str | Column) -> Column:
    return F.nullif(F.ltrim(F.regexp_extract(F.substring(text, 1, CIK_CHARS), r"CENTRAL INDEX KEY:\s*(\d+)", 1), F.lit("0")), F.lit(""))


def sections(text: Column, form: str | Column) -> Column:
    """array<struct<name, text>> in order of place: from each item's first hit to the next one, of the items of the filing's form.

    The whole text as full_text where fewer than two items hit, and in filings of other forms.
    """
    whole = F.array(F.struct(F.lit("full_text").alias("name"), text.alias("text")))

    def cut(items: tuple[tuple[str, str], ...]) -> Column:
        at = lambda p: F.regexp_instr(text, F.lit(p))
        found = F.array_sort(F.array_compact(F.array(*(F.when(at(p) > 0, F.struct(at(p).alias("at"), F.lit(n).alias("name"))) for n, p in items))))
        ends = F.concat(F.transform(F.slice(found, 2, 100), lambda x: x["at"]), F.array(F.length(text) + 1))
        strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
        made = F.zip_with(found, ends, lambda s, e: F.struct(s["name"].alias("name"), strip(F.substring(text, s["at"], e - s["at"])).alias("text")))
        return F.when(F.size(found) >= 2, made).otherwise(whole)

    if isinstance(form, str):
        return cut(SECTIONS[form]) if form in SECTIONS else whole
    out = whole
    for name, items in SECTIONS.items():
        out = F.when(form == name, cut(items)).otherwise(out)
    return out


def filings(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a tree with their dates; those without a filing date are left out."""
    return read_tree(spark, root).select("*", *header_dates("text"), cik("text").alias("cik")).where("filed is not null")
