"""Fiscal periods: labels of filings, periods that questions name, headings that denote them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that a 52- or 53-week year's end may move; days of a quarter.
TOLERANCE, QUARTER_DAYS = 7, 91.3
#: How questions name years and quarters.
FISCAL_YEAR = r"(?i)\b(?:fiscal(?:\s+year)?|fy)\s*'?(\d{4}|\d{2})\b"
PLAIN_YEAR = r"\b(19[89]\d|20[0-4]\d)\b"
QUARTER = r"(?i)\b(?:q([1-4])|(first|second|third|fourth)[\s-]+(?:fiscal[\s-]+)?quarter)\b"
#: Signed measures with their neutral forms, and words of direction.
MEASURES = (
    (r"(?i)\bnet\s+loss(es)?\b", "net income"),
    (r"(?i)\boperating\s+loss(es)?\b", "operating income"),
    (r"(?i)\bloss(es)?\s+per\s+share\b", "earnings per share"),
    (r"(?i)\bgross\s+loss\b", "gross profit"),
)
DIRECTIONS = r"(?i)\b(declin\w*|decreas\w*|fall|fell|fallen|drop\w*|shr[ia]nk\w*|contract\w*|increas\w*|ris(e|en|ing)|rose|gr[eo]w\w*)\b"
BOTH_WAYS = "increased decreased compared with the prior year"
#: Bases of accounting that a question may ask for.
BASES = (
    ("PRO FORMA", r"(?i)pro[\s-]*forma"),
    ("NON-GAAP", r"(?i)non[\s-]*gaap|\badjusted\s+(?:ebitda|ebit|eps|earnings|net\s+income|operating\s+income|operating\s+margin|diluted)"),
    ("MANAGED BASIS", r"(?i)managed[\s-]+basis"),
    ("CONSTANT CURRENCY", r"(?i)constant[\s-]+currency"),
)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date; 29 February of a common year is the 28th."""
    last = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.make_date(year, month, F.least(day, last))


def fiscal_label(doc_type: Column, period_end: Column, month: Column, day: Column) -> Column:
    """struct<year, part> of an annual or quarterly report; null if unknown."""
    this = safe_date(F.year(period_end), month, day)
    inside = period_end <= F.date_add(this, TOLERANCE)
    year = F.when(inside, F.year(period_end)).otherwise(F.year(period_end) + 1)
    before = F.when(inside, safe_date(F.year(period_end) - 1, month, day)).otherwise(this)
    quarter = F.greatest(F.lit(1), F.least(F.lit(3), F.round(F.date_diff(period_end, before) / QUARTER_DAYS).cast("int")))
    part = F.when(doc_type == "10-K", "FY").otherwise(F.concat(F.lit("Q"), quarter))
    known = doc_type.isin("10-K", "10-Q") & period_end.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(known, F.struct(year.alias("year"), part.alias("part")))


def expected_end(year: Column, part: Column, month: Column, day: Column) -> Column:
    """About when a period ends: so many days before the year's end."""
    days = F.when(part == "Q1", 274).when(part == "Q2", 183).when(part == "Q3", 91).otherwise(0)
    return F.date_sub(safe_date(year, month, day), days)


def requested_years(question: Column, fye_month: Column) -> Column:
    """Distinct fiscal years a question names, in order; bare years only where the fiscal year is the calendar year."""
    named = F.transform(F.regexp_extract_all(question, F.lit(FISCAL_YEAR), F.lit(1)), lambda y: y.cast("int") + F.when(F.length(y) == 2, 2000).otherwise(0))
    bare = F.transform(F.regexp_extract_all(question, F.lit(PLAIN_YEAR), F.lit(1)), lambda y: y.cast("int"))
    return F.array_distinct(F.when(F.size(named) > 0, named).when(fye_month == 12, bare).otherwise(F.array().cast("array<int>")))


def requested_periods(question: Column, fye_month: Column) -> Column:
    """array<struct<year, part>>: every named year with every named quarter, the fourth being the annual report."""
    number = lambda q: F.when(q.rlike("(?i)1|first"), "Q1").when(q.rlike("(?i)2|second"), "Q2").when(q.rlike("(?i)3|third"), "Q3").otherwise("FY")
    quarters = F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(QUARTER), F.lit(0)), number))
    parts = F.when(F.size(quarters) > 0, quarters).otherwise(F.array(F.lit("FY")))
    return F.flatten(F.transform(requested_years(question, fye_month), lambda y: F.transform(parts, lambda p: F.struct(y.alias("year"), p.alias("part")))))


def target_periods(asked: Column) -> Column:
    """Each asked period and the same one a year later, whose filing reports it beside its own; each once."""
    later = F.transform(asked, lambda p: F.struct((p["year"] + 1).alias("year"), p["part"].alias("part")))
    return F.array_distinct(F.concat(asked, later))


def format_period(year: Column, part: Column) -> Column:
    return F.when(part == "FY", F.concat(F.lit("fiscal year "), year)).otherwise(F.concat(part, F.lit(" of fiscal year "), year))


def source_header(ticker: Column, doc_type: Column, label: Column, period_end: Column, filed: Column) -> Column:
    """One line that identifies a source: its reporting period first, its filing date apart from it."""
    kind = F.when(doc_type == "10-K", "annual report").otherwise("quarterly report")
    period = (
        F.when(label.isNotNull() & period_end.isNotNull(), F.concat(F.lit("reporting period: "), format_period(label["year"], label["part"]), F.lit(", ended "), period_end.cast("string")))
        .when(period_end.isNotNull(), F.concat(F.lit("reporting period ended "), period_end.cast("string")))
        .otherwise("reporting period: unknown")
    )
    report = F.concat_ws("; ", F.concat(ticker, F.lit(" Form "), doc_type, F.lit(" ("), kind, F.lit(")")), period, F.concat(F.lit("filed "), filed.cast("string")))
    article = F.concat_ws("; ", F.concat_ws(" ", ticker, doc_type), F.concat(F.lit("published "), filed.cast("string")))
    return F.when(doc_type.isin("10-K", "10-Q"), report).otherwise(article)


def search_question(question: Column) -> Column:
    """The question, with neutral measures and both directions where it presumes one."""
    extra = F.array_compact(F.array(*(F.when(question.rlike(p), n) for p, n in MEASURES), F.when(question.rlike(DIRECTIONS), BOTH_WAYS)))
    return F.when(F.size(extra) > 0, F.concat(question, F.lit(" ("), F.array_join(extra, "; "), F.lit(")"))).otherwise(question)


def requested_bases(question: Column) -> Column:
    """Names of the bases a question asks for; reported where it names none. Dashes must be folded before."""
    asked = F.array_compact(F.array(*(F.when(question.rlike(p), n) for n, p in BASES)))
    return F.when(F.size(asked) > 0, asked).otherwise(F.array(F.lit("reported")))


def basis_of(rendered: Column) -> Column:
    """The basis in a rendered table's first line of that name."""
    return F.trim(F.split(F.regexp_extract(rendered, r"(?m)^Basis: ([^\n]*)", 1), r" \(")[0])


def column_matches(label: Column, year: Column, part: Column, end: Column) -> Column:
    """Whether a table's column heading denotes the period."""
    text = F.trim(label)
    low = F.lower(text)
    shape = r"\b((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})"
    found = F.regexp_extract_all(low, F.lit(shape), F.lit(0))
    piece = lambda m, k: F.regexp_extract(m, shape, k)
    as_date = lambda m: F.expr("date'1970-01-01'") if m is None else F.try_to_timestamp(F.concat_ws("-", piece(m, 3), F.initcap(piece(m, 1)), F.lpad(piece(m, 2), 2, "0")), F.lit("yyyy-MMM-dd")).cast("date")
    near = F.exists(found, lambda m: F.coalesce(F.abs(F.date_diff(as_date(m), end)) <= TOLERANCE, F.lit(False)))
    shorter = low.rlike(r"\b(three|six|nine)\s+months\b|\bquarter\b")
    quarterly = low.rlike(r"\bthree\s+months\b|\bquarter\b") | ~low.contains("months")
    q_shape = r"(?i)\b(?:([1-4])Q(\d{2})\b|Q([1-4])\s*'?(\d{2,4})\b)"
    q = F.concat(F.regexp_extract(text, q_shape, 1), F.regexp_extract(text, q_shape, 3))
    y = F.concat(F.regexp_extract(text, q_shape, 2), F.regexp_extract(text, q_shape, 4))
    named = (q != "") & (part != "FY")
    same = (F.concat(F.lit("Q"), q) == part) & (F.when(F.length(y) <= 2, F.concat(F.lit("20"), y)).otherwise(y) == year.cast("string"))
    dated = near & F.when(part == "FY", ~shorter).otherwise(quarterly)
    return dated | F.when(named, same).otherwise((part == "FY") & (text == year.cast("string")))
