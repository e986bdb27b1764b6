"""Prose of HTML pages by the standard parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "table", "noscript"}
#: Shorter prose isn't kept.
LEAST_CHARS = 500


class _Prose(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in SKIPPED

    def handle_endtag(self, tag: str) -> None:
        self.depth = max(0, self.depth - (tag in SKIPPED))

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def to_prose(html: str | None) -> str:
    """Text outside scripts, styles and tables, white space collapsed."""
    parser = _Prose()
    parser.feed(html or "")
    parser.close()
    return re.sub(r"\s+", " ", " ".join(parser.parts)).strip()


def prose_column(html: str | Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(to_prose)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(html)


def prose(pages: DataFrame, page_id: str, html: str, least: int = LEAST_CHARS) -> DataFrame:
    """(page_id, prose) of pages with enough of it."""
    return pages.select(page_id, prose_column(html).alias("prose")).where(F.length("prose") >= least)
