"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the keyword index.
TOKEN = r"[a-z0-9]+(?:[.,][0-9]+)*"
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ("U.S.", "U.K.", "E.U.", "e.g.", "i.e.", "etc.", "Dr.", "Mr.", "Mrs.", "Ms.", "Jr.", "Sr.", "Inc.", "Corp.", "Ltd.", "Co.", "LLC")
#: Dashes that count as a hyphen.
DASHES = "‐‑‒–—―−­"
#: A number in a claim; content words; words that aren't content.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
CONTENT_WORD = r"[a-z][a-z\-]{4,}"
STOP_WORDS = (
    "which", "their", "there", "these", "those", "would", "could", "should", "about", "other", "while", "where",
    "being", "based", "after", "before", "source", "sources", "company", "according", "including", "however",
)
MARK = "\u0001"


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: str | Column) -> Column:
    """Words and single punctuation marks: the offline stand-in for a subword tokenizer's count."""
    return F.regexp_count(_col(text), F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")).cast("long")


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sentences(text: str | Column) -> Column:
    """Sentences of more than ten characters; a full stop of an abbreviation is hidden while the text is cut."""
    t = _col(text)
    for k, short in enumerate(ABBREVIATIONS):
        t = F.replace(t, F.lit(short), F.lit(f"\u0002{k}\u0003"))
    t = F.regexp_replace(t, r"([.!?])(?:\s+(?=[A-Z])|\n+)", "$1" + MARK)
    for k, short in enumerate(ABBREVIATIONS):
        t = F.replace(t, F.lit(f"\u0002{k}\u0003"), F.lit(short))
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(t, MARK), strip), lambda s: F.length(s) > 10)


def numbers(text: str | Column) -> Column:
    """Distinct numbers, without thousands separators, final points and leading zeros, in order of first use."""
    plain = lambda n: F.regexp_replace(F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"\.+$", ""), "^0+(?=.)", "")
    bare = lambda n: F.when(n.startswith("."), F.concat(F.lit(""), n)).otherwise(n)
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit(NUMBER), F.lit(0)), lambda n: bare(plain(n))))


def fold_dashes(text: str | Column) -> Column:
    return F.translate(_col(text), DASHES, "-" * len(DASHES))


def normalised(text: str | Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(_col(text), r"\s+", " ")))


def excerpt(text: str | Column, length: int = 200) -> Column:
    t = _col(text)
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit("..."))).otherwise(t)


def defuse(text: str | Column, tag: str = "document") -> Column:
    """Closing tags of a prompt's fence, in any case and spacing, become harmless."""
    return F.regexp_replace(_col(text), rf"(?i)<\s*/\s*{tag}\s*>", f"[/{tag}]")


def mentions(text: str | Column, names: list[str]) -> Column:
    """Whether a name, as listed or in capitals, stands between characters that are neither letters nor digits."""
    spellings = sorted({v for n in names for v in (n, n.upper())})
    return _col(text).rlike(r"(?<![A-Za-z0-9])(?:" + "|".join(r"\Q" + s + r"\E" for s in spellings) + r")(?![A-Za-z0-9])")


def attribution(title: Column, body: Column, names: list[str]) -> Column:
    return F.when(mentions(title, names), "news_title").when(mentions(body, names), "news_body")


def content_words(text: str | Column) -> Column:
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(CONTENT_WORD), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def parsed_object(text: str | Column, schema: str) -> Column:
    """The JSON object inside a reply that may surround it with prose or a fence."""
    return F.from_json(F.regexp_extract(_col(text), r"(?s)\{.*\}", 0), schema)


def direction(score: str | Column, at: float = 0.1, inclusive: bool = True) -> Column:
    s = _col(score)
    up, down = (s >= at, s <= -at) if inclusive else (s > at, s < -at)
    return F.when(up, "positive").when(down, "negative").when(s.isNotNull(), "neutral")


def clamped(value: Column, low: float, high: float) -> Column:
    """Finite values within bounds; NaN and infinities are null, tested before clamping."""
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(low), F.least(F.lit(high), value)))
