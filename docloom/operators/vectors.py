"""Exact vector search by inner product, and the trust rules between vectors and the texts they were made from."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators.best import Best, ranked, schema_of

#: Numbers of queries that go to tasks at once, scores of one block, vectors of one block at most, numbers of pairs scored again at a time, pairs from which vectors are dealt to all cores.
MOST_ASKED, CELLS, ROWS, NUMBERS, MANY_PAIRS = 2_000_000, 4_000_000, 4096, 3_200_000, 20_000_000


def normalised(vector: str | Column) -> Column:
    """v / (|v| + 1e-8), in doubles."""
    v = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + F.lit(1e-8)
    return F.transform(v, lambda x: x / length)


def inner(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _irregular(vector: str) -> Column:
    """Not a vector of finite numbers."""
    return F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of each query vector, exact; queries are (query_id, query).

    Scores are clipped to 0 to 1. All pairs are scored, in blocks of single precision whose error is bounded, and what
    may be among the k best again in doubles; each task hands on k of each query. Queries go to the tasks MOST_ASKED
    numbers at a time, each such part with a pass over the vectors. Vectors of several sizes or with other than finite
    numbers are scored row by row.
    """
    size = lambda c: (F.min(F.size(c)).alias("low"), F.max(F.size(c)).alias("high"), F.count("*").alias("n"), F.bool_or(_irregular(c)).alias("odd"))
    q, v = queries.agg(*size("query")).first(), vectors.agg(*size("embedding")).first()
    found = schema_of(queries.schema["query_id"], vectors.schema["vec_id"], "vec_id")
    if not q.n or not v.n:
        return ranked(queries.sparkSession.createDataFrame([], found), k, "vec_id")
    if q.odd or v.odd or len({q.low, q.high, v.low, v.high}) > 1 or not q.low:
        return ranked(_all_pairs(vectors, queries), k, "vec_id")
    rows = vectors.select("vec_id", "embedding")
    if q.n * v.n > MANY_PAIRS:
        rows = rows.repartition(max(1, queries.sparkSession.sparkContext.defaultParallelism))
    parts = -(-q.n * q.low // MOST_ASKED)
    key = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    asked = (queries.where(key == p).select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow() for p in range(parts))
    made = [rows.mapInArrow(_nearest(t.column(0).to_pylist(), _units(t.column(1)), k, found), found) for t in asked if t.num_rows]
    return ranked(reduce(DataFrame.unionByName, made), k, "vec_id")


def _all_pairs(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    unit = vectors.select("vec_id", normalised("embedding").alias("unit"))
    asked = queries.select("query_id", normalised("query").alias("asked"))
    both = unit.join(F.broadcast(asked), F.lit(True))
    scored = both.select("query_id", "vec_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), inner("unit", "asked"))).alias("score"))
    return scored.withColumn("rounded", F.round("score", 9))


def _units(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows divided by their length plus 1e-8, in doubles."""
    flat = (vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy(zero_copy_only=False)
    m = flat.astype(float).reshape(len(vectors), -1)
    return m / (np.sqrt(_added(m * m)) + 1e-8)[:, None]


def _added(rows: np.ndarray) -> np.ndarray:
    """Sums of rows, one number after the other, so that equal rows have equal sums wherever they stand."""
    return np.ascontiguousarray(rows.T).sum(axis=0)


def _nearest(names: list, asked: np.ndarray, k: int, schema: StructType) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    margin = (asked.shape[1] + 8) * 1.2e-7  # more than the error of single precision, for vectors of length 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, small, begun = Best(len(names), k), np.ascontiguousarray(asked.T, np.float32), False
        step, pairs = min(ROWS, max(k, CELLS // len(names))), max(1, NUMBERS // asked.shape[1])
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                ids, unit = np.array(part.column(0).to_pylist()), _units(part.column(1))
                near = unit.astype(np.float32) @ small
                if not begun and len(ids) >= k:
                    # The k-th best of the first block, less the error, is a bound from below.
                    best.low = np.maximum(0, np.partition(near, len(ids) - k, axis=0)[len(ids) - k].astype(float) - 2 * margin)
                    begun = True
                maybe = near >= (best.low - margin).astype(np.float32)
                clipped = np.flatnonzero(best.low <= 0)
                if len(clipped):  # all below 0 tie at 0, by id
                    known = best.full[clipped] if best.worst is not None else np.zeros(len(clipped), bool)
                    maybe[:, clipped] |= ~known | (ids[:, None] < best.worst[clipped] if best.worst is not None else True)
                row, query = np.nonzero(maybe)
                for c in range(0, len(row), pairs):
                    i, j = row[c : c + pairs], query[c : c + pairs]
                    best.add(j, ids[i], np.clip(_added(unit[i] * asked[j]), 0, 1))
                if best.size > best.queries * k:
                    best.cut()
        yield from best.batches(names, schema)

    return run


def trusted(hits: DataFrame, current: DataFrame) -> DataFrame:
    """Hits (vec_id, vec_hash) whose hash is known and isn't contradicted by the text's hash; unknown ids stay."""
    joined = hits.join(current.select("vec_id", "text_hash"), "vec_id", "left")
    known = F.col("vec_hash") != ""
    agrees = F.col("text_hash").isNull() | (F.col("text_hash") == "") | (F.col("text_hash") == F.col("vec_hash"))
    return joined.where(known & agrees).select(hits.columns)


def index_facts(vectors: DataFrame) -> DataFrame:
    """One row: counts, distinct ids and the range of dimensions, as an index is validated by."""
    size = F.size("embedding")
    return vectors.agg(F.count("*").alias("vectors"), F.count_distinct("vec_id").alias("ids"), F.min(size).cast("long").alias("min_dim"), F.max(size).cast("long").alias("max_dim"))


def upsert_actions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, action): insert, replace or skip, from ids and hashes; a stored blank hash is always replaced."""
    s = stored.select("id", F.col("hash").alias("stored_hash"), F.lit(True).alias("stored"))
    joined = incoming.join(s, "id", "left")
    action = (
        F.when(F.col("stored").isNull(), "insert")
        .when(F.col("hash").isNull() | (F.col("hash") == ""), "skip")
        .when((F.col("stored_hash") == "") | (F.col("stored_hash") != F.col("hash")), "replace")
        .otherwise("skip")
    )
    return joined.select("id", action.alias("action"))
