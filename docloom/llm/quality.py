"""Quality: two zstandard dictionaries, of good and of bad labelled text, compress each text.

The normalised difference of the two sizes, (bad - good) / (bad + good), becomes a score by logistic calibration
on labelled rows that the dictionaries haven't seen; nothing else of a text enters it. Dictionaries and
calibration come from a bounded sample (max_rows, max_chars, and no text of over a share of those characters);
every text is compressed whole, whatever its length. Nulls are empty texts (difference 0); repeated and tied
texts score alike; without labelled rows the score is one constant; an empty table gives an empty table; no
column but the text (and, in train, the id) is read, and rows without an id are scored like others.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, give_back
from docloom.llm.sampling import labelled_sample

DICT_BYTES = 112 << 10
LEVEL = 3
PIECE, PIECES_OF_ONE, MOST_PIECES = 1000, 4, 6000


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


class Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_checksum=False, write_content_size=False) for d in (good, bad)]

    def difference(self, text: str) -> float:
        """How much longer a text is under the bad dictionary than under the good one, of both lengths' sum."""
        raw = text.encode()
        if not raw:
            return 0.0
        good, bad = (len(c.compress(raw)) for c in self.pair)
        return (bad - good) / (bad + good)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
    made.precompute_compress(level=LEVEL)
    return made


def build_dictionary(texts: list[str], size: int = DICT_BYTES, pieces_of_one: int | None = PIECES_OF_ONE, most_pieces: int | None = MOST_PIECES) -> bytes:
    """A trained dictionary with its entropy tables, from the first pieces of each text (None: all of them); of too little text, the text itself."""
    pieces = [t[i : i + PIECE].encode() for t in texts for i in range(0, len(t), PIECE)[:pieces_of_one]][:most_pieces]
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size] or b"\n" * 8


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton steps, halved until the loss falls."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge * (w @ w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        before = loss(w)
        while loss(w + step) > before and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(texts: list[str], labels: list[int], pieces_of_one: int | None = PIECES_OF_ONE, most_pieces: int | None = MOST_PIECES) -> Model:
    """Rows at even places make the dictionaries, those at odd places the calibration."""
    first = [(t, y) for t, y in zip(texts[::2], labels[::2], strict=True) if t]
    good, bad = (build_dictionary([t for t, y in first if y == want], DICT_BYTES, pieces_of_one, most_pieces) for want in (1, 0))
    sizes = Sizes(good, bad)
    rest = list(zip(texts[1::2], labels[1::2], strict=True)) or [("", 1)]
    x = _inputs(sizes, [t for t, _ in rest])
    return Model(good, bad, calibrate(x, np.array([float(y) for _, y in rest])))


def _inputs(sizes: Sizes, texts: Iterable[str]) -> np.ndarray:
    """Of each text an intercept and ten times its difference."""
    return np.array([(1.0, 10 * sizes.difference(t)) for t in texts]).reshape(-1, 2)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_chars: int = 16_000_000, pieces_of_one: int | None = PIECES_OF_ONE, most_pieces: int | None = MOST_PIECES) -> Model:
    """The dictionaries take pieces_of_one pieces of PIECE characters from each text's beginning, most_pieces at most; None: no such bound."""
    bounded_batches(docs.sparkSession)
    model = fit(*labelled_sample(docs, labels, "quality", max_rows, max_chars), pieces_of_one, most_pieces)
    gc.collect()
    give_back()
    return model


def score_column(model: Model, text: str = "text") -> Column:
    """The score of every whole text; the dictionaries are of fixed size."""
    good, bad, weights = model.good, model.bad, np.array(model.weights)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = Sizes(good, bad)
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(_inputs(sizes, texts) @ weights, -30, 30))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.coalesce(F.col(text), F.lit("")))
