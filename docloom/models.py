"""Models behind plain functions of columns, each with a deterministic stand-in that needs no network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import TOKEN, tokens

DIM = 256
#: Fixed values of the stand-in scorer: words that speak for and against.
POSITIVE = ("growth", "record", "strong", "beat", "profit", "improved", "gain", "raised")
NEGATIVE = ("loss", "decline", "weak", "miss", "impairment", "lawsuit", "fell", "cut")


def hashed_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed feature hashing of tokens, of unit length."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = re.compile(TOKEN).findall
        for b in batches:
            out = []
            for t in b:
                v = np.zeros(dim, np.float64)
                for w in find((t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % dim] += 1 if h >> 31 else -1
                out.append((v / (np.linalg.norm(v) + 1e-8)).astype(np.float32))
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def overlap_relevance(question: Column, window: Column) -> Column:
    """Share of a question's distinct tokens that a window has."""
    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(window))) / F.size(q)).otherwise(0.0)


def lexicon_sentiment(text: Column) -> Column:
    """struct<score, confidence, reliable> from counts of two word lists."""
    words = tokens(text)
    count = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    up, down = count(POSITIVE), count(NEGATIVE)
    return F.struct(
        F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0).alias("score"),
        F.least(F.lit(1.0), (up + down) / 4.0).alias("confidence"),
        (up + down > 0).alias("reliable"),
    )


@dataclass(frozen=True)
class Models:
    embed: Callable[[Column], Column] = hashed_embedding
    relevance: Callable[[Column, Column], Column] = overlap_relevance
    sentiment: Callable[[Column], Column] = lexicon_sentiment
