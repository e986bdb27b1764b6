"""The k best of each query within a task: bounded by queries times k, however many rows are scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

#: Digits by which scores are compared, rows of one batch of results, scores that are held beside the best before they are sorted.
DIGITS, ROWS, SPARE = 9, 50_000, 200_000


def rounded(scores: np.ndarray) -> np.ndarray:
    """To DIGITS, half away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 10.0**DIGITS + 0.5) / 10.0**DIGITS, scores) + 0.0


class Best:
    """Of all that is added, each query's k best by rounded score, ties by id; low and worst are what the k-th of a query has."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries = k, queries
        self.low, self.full = np.full(queries, -np.inf), np.zeros(queries, bool)
        self.worst: np.ndarray | None = None
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        r = rounded(scores)
        keep = r >= self.low[query]
        if self.worst is not None:
            keep &= (r > self.low[query]) | ~self.full[query] | (ids < self.worst[query])
        self.held.append((query[keep], ids[keep], r[keep], scores[keep]))
        self.size += int(keep.sum())
        if self.size > 2 * self.queries * self.k + SPARE:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...] | None:
        if not self.held:
            return None
        query, ids, r, scores = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, -r, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        query, last = query[place < self.k], place[place < self.k] == self.k - 1
        ids, r, scores = ids[order], r[order], scores[order]
        self.held, self.size = [(query, ids, r, scores)], len(query)
        self.worst = np.zeros(self.queries, ids.dtype) if self.worst is None else self.worst.astype(np.promote_types(self.worst.dtype, ids.dtype))
        self.low[query[last]], self.worst[query[last]], self.full[query[last]] = r[last], ids[last], True
        return self.held[0]

    def batches(self, names: list, schema: StructType) -> Iterator[pa.RecordBatch]:
        """(query_id, id, rounded, score) of what is best; names are the queries' ids."""
        found = self.cut()
        for a in range(0, self.size if found else 0, ROWS):
            query, *rest = (x[a : a + ROWS].tolist() for x in found)
            columns = [[names[q] for q in query], *rest]
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], names=schema.names)


def schema_of(query_id: StructField, ids: StructField, name: str) -> StructType:
    return StructType([StructField("query_id", query_id.dataType), StructField(name, ids.dataType), StructField("rounded", DoubleType()), StructField("score", DoubleType())])


def ranked(found: DataFrame, k: int, name: str) -> DataFrame:
    """(query_id, name, score, rank) of the tasks' best."""
    best = Window.partitionBy("query_id").orderBy(F.col("rounded").desc(), name)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", name, "score", "rank")
