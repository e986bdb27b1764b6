"""SentencePiece encoding and decoding through a table of distinct marked words.

Pieces of a whitespace-split model cannot cross the marker, so each distinct marked word is segmented
once and ids are joined back by position; the result equals the library's on the whole text.
Nulls are empty texts; an empty text has the end id alone and decodes to an empty text; a text of any length is
one row, cut and looked up like others; rows that repeat, and rows without an id, are encoded each and keep
their ids; words of equal hash are told apart by their bytes; an empty table gives an empty table; columns other
than id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import chunks

_models: dict[int, object] = {}


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()


def encode(docs: DataFrame, model: bytes, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): as SentencePieceProcessor.encode, without sampling or a begin id."""
    return chunks.encode(docs, "piece", model, end_id, doc_id, text)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids, decoded): as SentencePieceProcessor.decode(ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        m = _models.get(hash(model)) or _models.setdefault(hash(model), sentencepiece.SentencePieceProcessor(model_proto=model))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                texts = m.decode([x or [] for x in b.column(1).to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, encoded.select("doc_id", "ids").schema.add("decoded", "string"))
